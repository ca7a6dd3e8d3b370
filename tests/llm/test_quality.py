"""Quality: the fit against plain Newton steps, features by hand, the threshold, held-out accuracy, edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from logweave.llm import quality

DOCS = "doc_id long, text string, score double, value string"
LABELS = "doc_id long, quality int, toxic int"


def prose(r, n=60):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n)).capitalize() + "."


def made(n=400, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        text = prose(r) if good else r.choice([" ".join(w + "&&&" for w in prose(r).split()), prose(r).upper() + "!!", "word " * 50, " | ".join(prose(r).split())])
        docs.append((i, text, 0.5, "x"))
        labels.append((i, int(good), 0))
    return docs, labels


def test_features_of_plain_texts():
    texts = ["One two two. Three!", None, "", "A&& b && C123 é", "x" * 30 + "\nyy yy"]
    got = np.concatenate([x for _, x in quality.features(pa.array(texts))])
    f = dict(zip(quality.FEATURES, got[0]))
    assert np.isclose(f["words"], np.log(5)) and np.isclose(f["word_length"], 16 / 4) and np.isclose(f["marks"], 2 / 16) and np.isclose(f["capitals"], 2 / 14)
    assert f["repeated"] == f["symbols"] == 0 and not got[1].any() and not got[2].any()
    f = dict(zip(quality.FEATURES, got[3]))
    assert np.isclose(f["symbols"], 4 / 12) and np.isclose(f["digits"], 3 / 12) and np.isclose(f["wide"], 2 / 12) and np.isclose(f["no_letters"], 1 / 5) and np.isclose(f["ends_odd"], 2 / 5)
    f = dict(zip(quality.FEATURES, got[4]))
    assert np.isclose(f["repeated"], 1 / 3) and np.isclose(f["lines"], 1 / 3) and np.isclose(f["long_words"], 1 / 3) and np.isclose(f["distinct"], 2 / 3**0.8)


def test_the_fit_is_the_minimum_of_the_pairwise_loss():
    r = np.random.default_rng(3)
    x = r.normal(size=(80, 3))
    better, worse = r.integers(0, 80, 200), r.integers(0, 80, 200)
    swap = (x[better] @ [1.0, -2.0, 0.3]) + r.normal(size=200) < (x[worse] @ [1.0, -2.0, 0.3])
    better, worse = np.where(swap, worse, better), np.where(swap, better, worse)
    model = quality.fit_pairs(x, better, worse, bins=4)
    z = model.expand(x)
    d = z[better] - z[worse]
    w = np.zeros(z.shape[1])
    for _ in range(200):  # plain Newton on sum log(1 + exp(-d w)) + w w / 2
        p = 1 / (1 + np.exp(d @ w))
        w += np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + np.eye(len(w)), d.T @ p - w) / 2
    assert np.abs(w - model.weights).max() < 1e-5
    none = quality.fit_pairs(x, better[:0], worse[:0])
    assert not none.scores(x).any()


def test_preferences_are_few_and_between_labels(spark):
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(300)], "doc_id long, good boolean")
    got = {(r["better"], r["worse"]) for r in quality.preferences(labels, train_rows=200, opponents=3).collect()}
    assert got == {(r["better"], r["worse"]) for r in quality.preferences(labels.repartition(7), train_rows=200, opponents=3).collect()}
    assert all(b % 3 == 0 and w % 3 for b, w in got) and 200 <= len(got) <= 600 and len({x for p in got for x in p}) <= 200
    assert quality.preferences(labels.where("good")).count() == 0


def test_held_out_documents_are_told_apart_and_the_threshold_is_a_quantile(spark):
    docs, labels = made()
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    got = {r["doc_id"]: r for r in quality.score(d, l).collect()}
    held = [i for i, *_ in docs if got[i]["held_out"]]
    assert len(held) > 50 and np.mean([got[i]["predicted"] == labels[i][1] for i in held]) >= 0.97
    assert all((g["score"] >= 0.3) == (g["predicted"] == 1) and 0 <= g["score"] <= 1 for g in got.values())
    known = [i for i, *_ in docs if not got[i]["held_out"]]
    assert abs(np.mean([got[i]["predicted"] for i in known]) - np.mean([labels[i][1] for i in known])) < 0.01
    half = {r["doc_id"]: r["predicted"] for r in quality.score(d, l, quantile=0.5).collect()}
    assert abs(np.mean([half[i] for i in known]) - 0.5) < 0.02
    # Ids, labels of the held-out fifth and the order of rows change nothing.
    flipped = spark.createDataFrame([(i, 1 - q if got[i]["held_out"] else q, 1) for i, q, _ in labels], LABELS)
    again = {r["doc_id"]: r["score"] for r in quality.score(d.repartition(5), flipped).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-9 for i in again)


def test_own_preferences_can_be_learned(spark):
    docs, labels = made(80, 4)
    good, bad = [i for i, q, _ in labels if q], [i for i, q, _ in labels if not q]
    pairs = spark.createDataFrame([(g, b) for g, b in zip(good, bad)] + [(good[0], 9999), (good[0], good[0])], "better long, worse long")
    model = quality.fit(spark.createDataFrame(docs, DOCS), pairs)
    value = {r["doc_id"]: r["value"] for r in quality.rank(spark.createDataFrame(docs, DOCS), model).collect()}
    assert np.mean([value[g] > value[b] for g in good for b in bad]) > 0.9


@pytest.mark.parametrize("kind", ["odd rows", "one label", "no labels", "no docs"])
def test_edge_cases(spark, kind):
    docs, labels = made(120, 5)
    docs += [(500, None, None, None), (501, "", None, None), (None, docs[0][1], None, None), (0, docs[0][1], None, None), (502, "z" * 300_000, 0.1, "y"), (503, "漢字" * 50_000, 0.1, "y")]
    labels += [(1, 1 - labels[1][1], 0), (None, 1, 0), (7, None, None), (9999, 1, 0), (500, 0, 0)]
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    if kind == "one label":
        l = l.where("quality = 1")
    if kind == "no labels":
        l = l.limit(0)
    if kind == "no docs":
        d = d.limit(0)
    got = quality.score(d, l).collect()
    assert len(got) == (0 if kind == "no docs" else len(docs))
    if kind in ("one label", "no labels"):
        assert {(r["score"], r["predicted"]) for r in got} == {(0.3, 1)}
    if kind == "odd rows":
        by = {}
        for r in got:
            by.setdefault(r["doc_id"], set()).add(r["score"])
        assert by[0] == by[None] and len(by[0]) == 1 and by[500] == by[501]
