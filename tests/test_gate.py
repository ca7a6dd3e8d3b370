"""The gate's neighbours, threshold, split and classifier against plain computations."""

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import Window
from pyspark.sql import functions as F

from logweave.functions.quantiles import exact_quantile
from logweave.operators import gate, reports, tiers
from logweave.plans import catalog


def vectors(spark, n, seed, first=0):
    """Unit vectors over terms of very unequal frequency."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        at = np.unique(np.minimum(r.zipf(1.25, 14) - 1, 3999))
        w = r.uniform(0.5, 1.5, len(at)) * np.log(2 + at)
        w /= np.linalg.norm(w)
        rows += [(first + i, f"t{t}", float(x)) for t, x in zip(at, w)]
    return spark.createDataFrame(rows, "id long, term string, w double")


@pytest.fixture(scope="module")
def tables(spark):
    """Queries of which most resemble a known vector, as masked lines do, and known vectors."""
    def like(base, times, first):
        rows = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("id", first + F.col("id") * times + F.col("copy"))
        rows = rows.withColumn("w", F.col("w") * (1 + (F.hash("id", "term") % 100) / 400))
        return rows.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") ** 2).over(Window.partitionBy("id")))).select("id", "term", "w")

    base = vectors(spark, 225, 2)
    return like(base.where("id < 100"), 1, 5000).unionByName(vectors(spark, 20, 1, 6000)), like(base, 4, 0)


def test_pruned_neighbours_are_the_nearest_and_few_pairs_are_looked_at(spark, tables, monkeypatch):
    query, known = tables
    place = {f"t{i}": i for i in range(4000)}
    dense = lambda df: {i: v for i, v in _dense(df, place).items()}
    q, x = dense(query), dense(known)
    got = {}
    for r in gate.nearest(query, known).collect():
        got.setdefault(r["q"], []).append((-r["dot"], r["x"]))
    for i, v in q.items():
        dots = sorted((-round(float(v @ w), 9), j) for j, w in x.items())
        want = [d for d in dots[:3] if d[0] < 0]
        assert [round(d, 8) for d, _ in sorted(got.get(i, []))] == [round(d, 8) for d, _ in want]
    pairs = gate.candidates(query, known).count()
    touching = query.select("id", "term").join(known.select(F.col("id").alias("x"), "term"), "term").select("id", "x").distinct().count()
    assert pairs < 0.35 * touching and touching > 0.6 * 120 * 900


def _dense(df, place):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], np.zeros(4000))[place[r["term"]]] = r["w"]
    return out


def test_threshold_counts_copies_exactly(spark):
    r = random.Random(2)
    rows = [(r.random(), r.randint(1, 9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "distance double, copies long")
    flat = np.repeat([d for d, _ in rows], [c for _, c in rows])
    assert abs(gate.threshold(df, F.col("copies")) - np.quantile(flat, 0.99)) < 1e-12
    assert gate.threshold(df.limit(0)) == gate.FLOOR
    got = exact_quantile(df, F.col("distance"), 0.5, copies=F.when(F.col("copies") > 3, F.col("copies")).otherwise(0)).first()
    flat = np.repeat([d for d, c in rows if c > 3], [c for _, c in rows if c > 3])
    assert got["n"] == len(flat) and abs(got["quantile"] - np.quantile(flat, 0.5)) < 1e-12


def test_split_takes_exactly_a_fifth_of_every_label(spark):
    rows = [(i, "big" if i % 3 else "small") for i in range(999)] + [(1000 + i, None) for i in range(11)] + [(2000, "one")]
    df = spark.createDataFrame(rows, "id long, label string").repartition(7)
    got = gate.split(df, buckets=16).groupBy("label").agg(F.count("*").alias("n"), F.count_if("held_out").alias("held")).collect()
    assert {r["label"]: (r["n"], r["held"]) for r in got} == {"big": (666, 133), "small": (333, 66), None: (11, 2), "one": (1, 0)}
    once, again = (sorted(r["id"] for r in gate.split(x, buckets=b).where("held_out").collect()) for x, b in ((df, 16), (df.repartition(3), 4096)))
    assert once == again


def test_classifier_is_a_plain_logistic_fit_and_is_saved_whole(spark, tmp_path):
    r = random.Random(6)
    words = {"a": ["red", "rose", "root"], "b": ["blue", "boat", "bird"], "c": ["red", "boat", "calm"]}
    lines = [(k, " ".join(r.choice(words[k]) for _ in range(4))) for k in "abc" for _ in range(25)]
    df = spark.createDataFrame(lines, "label string, text string")
    model = gate.fit_families(df, rounds=2000, tolerance=1e-13)
    model.write().overwrite().save(str(tmp_path / "m"))
    got = PipelineModel.load(str(tmp_path / "m")).transform(df).select("label", "text", "x", "probability").collect()
    assert sorted(map(str, got)) == sorted(map(str, model.transform(df).select("label", "text", "x", "probability").collect()))
    x, y = np.array([g["x"].toArray() for g in got]), np.array(["abc".index(g["label"]) for g in got])
    assert np.allclose(np.linalg.norm(x, axis=1), 1)
    # Newton steps on the same loss: mean log loss and 1 / (16 n) of the squared weights; intercepts are free.
    n, d = x.shape
    z, hot = np.hstack([x, np.ones((n, 1))]), np.eye(3)[y]
    w, keep = np.zeros((3, d + 1)), np.append(np.full(d, 1 / (8 * n)), 1e-12)
    for _ in range(40):
        p = np.exp(z @ w.T)
        p /= p.sum(axis=1, keepdims=True)
        grad = ((p - hot).T @ z) / n + w * keep
        hess = np.zeros((3 * (d + 1), 3 * (d + 1)))
        for a in range(3):
            for b in range(3):
                block = (z * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z / n
                hess[a * (d + 1) : (a + 1) * (d + 1), b * (d + 1) : (b + 1) * (d + 1)] = block + (np.diag(keep) if a == b else 0)
        w -= np.linalg.lstsq(hess, grad.ravel(), rcond=None)[0].reshape(3, d + 1)
    assert np.abs(p - np.array([g["probability"].toArray()[:3] for g in got])).max() < 1e-6
    assert gate.predict(model, df).where("family_guess = label").count() >= 70


def test_neighbours_by_blocks_are_those_of_all_pairs_and_no_pairs_are_shuffled(spark, tables, monkeypatch):
    """Blocks smaller than the tables, ties, and copies; only the nearest of each block leave their task."""
    query, known = tables
    known = known.unionByName(known.where("id < 40").withColumn("id", F.col("id") + 10_000))  # equal vectors tie
    whole = sorted(map(tuple, gate.nearest(query, known).collect()))
    monkeypatch.setattr(gate, "KNOWN_ROWS", 150)
    monkeypatch.setattr(gate, "QUERY_ROWS", 50)
    monkeypatch.setattr(gate, "CELLS", 100_000)
    assert sorted(map(tuple, gate.nearest(query, known).collect())) == whole
    place = {r["term"]: i for i, r in enumerate(known.select("term").distinct().collect())}
    places = gate._placed(known.select("term").distinct())
    q, x = gate._packed(query, places), gate._packed(known, places)
    pairs = gate._products(q, x, len(place), 3).count()
    assert pairs <= q.count() * 3 * -(-x.count() // 150)


def test_a_gate_of_counted_lines_is_that_of_the_lines(spark):
    lines = spark.createDataFrame([("user login ok", "a")] * 4 + [("user login ok", "b")] * 4 + [("disk full", "b"), ("disk full", None), ("link down", "c")] * 2, "text string, label string")
    counted = lines.groupBy("text", "label").agg(F.count("*").alias("copies"))
    asked = spark.createDataFrame([("user login bad",), ("disk link",), ("zzz",)], "text string")
    one, other = gate.Novelty(lines, lines), gate.Novelty(counted, counted, copies=F.col("copies"))
    assert one.limit == other.limit and sorted(map(str, one.score(asked).collect())) == sorted(map(str, other.score(asked).collect()))
    assert {r["text"]: r["label"] for r in one.known.collect()} == {"user login ok": "a", "disk full": "b", "link down": "c"}


def test_texts_are_taken_apart_by_all_cores(spark):
    """However few bytes they are: by bytes alone one task had all n-grams."""
    lines = spark.range(200).select("id", F.concat(F.lit("job "), "id", F.lit(" of the queue is done")).alias("text"))
    assert gate.tfidf(lines, gate.vocabulary(lines)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["per_unknown", "precision_recall", "run_summary"])
def test_lines_the_gate_is_asked_about_are_not_made_again_by_what_reads_its_results(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" not in plan


def test_reports_of_counted_rows_are_those_of_the_rows(spark):
    """Null guesses are left out of a mean, with their copies."""
    rows = spark.createDataFrame([("a", "a", True, False, 3), ("a", None, True, True, 2), ("b", "a", True, False, 4), ("x", "b", False, True, 5), ("x", None, False, False, 1)], "family string, gate_family string, known boolean, gate_novel boolean, copies int")
    lines = rows.select("*", F.explode(F.expr("sequence(1, copies)")).alias("i"))
    for of in (lambda r, n: reports.precision_recall(r, ~F.col("known"), n), tiers.accuracy):
        assert of(rows, F.col("copies")).first() == of(lines, None).first()
    assert tiers.accuracy(rows, F.col("copies")).first()["accuracy"] == 3 / 12 and reports.precision_recall(rows.limit(0), ~F.col("known"), F.col("copies")).first() == (None, None, None)
