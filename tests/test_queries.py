"""Registered queries against their SQL in DuckDB over the smallest tables."""

import datetime
import math

import duckdb
import pytest

from logweave.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([plain(r[i]) for i in at]) for r in rows)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES])
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert ordered(got.columns, [tuple(r) for r in got.collect()]) == ordered(columns, want.fetchall())


def test_newest_runs_of_any_size_equal_their_sql(spark, tmp_path):
    """Three days of 2 MB each are more than a store of runs keeps, but the query has no such limit."""
    from pyspark.sql import functions as F

    rows = spark.range(80).select(F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 4 as int), cast(id div 4 as int))").alias("ts"), F.repeat(F.lit("x"), 100_000).alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["newest_runs"]).fetchall()
    assert sorted(map(tuple, catalog.newest_runs(spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 3


def test_templates_are_mined_as_line_by_line(spark):
    from logweave.operators import mining

    rows = [(r["seq"], r["raw"]) for r in catalog._corpus(spark, SF).select("seq", "raw").collect()]
    got = mining.mine(spark.createDataFrame(rows, "seq long, raw string")).collect()
    assert sum(r["size"] for r in got) == len(rows)
    masked = {}
    for t in sorted(got, key=lambda r: r["first_seq"]):
        masked.setdefault(t["masked"], t)
    leaves = {}
    for text in masked:  # Drain over all masked lines in order of arrival, in one process
        tokens = text.split()
        key = (len(tokens), *("<*>" if any(c.isdigit() for c in x) else x for x in tokens[:2]))
        groups = leaves.setdefault(key, [])
        best = max(range(len(groups)), key=lambda i: (sum(a == b for a, b in zip(groups[i][0], tokens)), -i), default=None)
        if best is not None and sum(a == b for a, b in zip(groups[best][0], tokens)) >= 0.5 * len(tokens):
            groups[best] = ([a if a == b else "<*>" for a, b in zip(groups[best][0], tokens)], [*groups[best][1], text])
        else:
            groups.append((tokens, [text]))
    want = {text: " ".join(tokens) for groups in leaves.values() for tokens, texts in groups for text in texts}
    assert {r["masked"]: r["template"] for r in got} == want
    view = mining.template_view(mining.mine(spark.createDataFrame(rows, "seq long, raw string")), 5).collect()
    assert len(view) == 5 and view[0]["size"] == max(r["size"] for r in view)


def test_gate_reaches_its_floors(spark):
    got = {r["label"]: r for r in catalog.gate_families(spark, "/root/testdata/sf0.01").collect()}
    assert sum(r["n"] * r["accuracy"] for r in got.values()) / sum(r["n"] for r in got.values()) >= 0.95
    got = catalog.gate_evaluation(spark, SF).first()
    assert got["accuracy"] >= 0.95 and got["caught"] >= 0.9 and got["false_alarm"] <= 0.05


def test_rows_are_numbered_across_ranges(spark):
    from pyspark.sql import functions as F

    from logweave.operators import rules

    rows = spark.range(500).select(F.col("id").alias("seq"), F.when(F.col("id") % 5 != 0, F.lit("hot")).otherwise(F.when(F.col("id") % 3 == 0, F.col("id").cast("string"))).alias("k"))
    seen = {}
    for r in rules.numbered(rows, ["k"], "nth", width=60).orderBy("seq").collect():
        seen[r["k"]] = seen.get(r["k"], 0) + 1
        assert r["nth"] == seen[r["k"]]
    assert seen["hot"] == 400


def test_gate_copies_weigh_as_repeated_lines(spark):
    from pyspark.sql import functions as F

    from logweave.operators import gate

    few = spark.createDataFrame([(1, "user login ok", 5), (2, "user login failed", 2), (3, "disk full on host", 1), (4, "link down", 1)], "id long, text string, copies long")
    many = few.select("id", "text", F.explode(F.expr("sequence(1L, copies)")).alias("i")).select((F.col("id") * 100 + F.col("i")).alias("id"), "text")
    terms = {r["term"]: r["idf"] for r in gate.vocabulary(few, copies=F.col("copies")).collect()}
    assert terms == pytest.approx({r["term"]: r["idf"] for r in gate.vocabulary(many).collect()})
    v, asked = gate.vocabulary(many), spark.createDataFrame([(1, "user login ok"), (2, "user logout failed"), (3, "disk login")], "id long, text string")
    q = gate.tfidf(asked, v)
    got = {r["id"]: r["distance"] for r in gate.distances(q, gate.tfidf(few, v), copies=few).collect()}
    assert got == pytest.approx({r["id"]: r["distance"] for r in gate.distances(q, gate.tfidf(many, v)).collect()}, abs=1e-6)
    scored = spark.createDataFrame([(0.1, 97), (0.5, 2), (0.9, 1)], "distance double, copies int")
    assert gate.threshold(scored, F.col("copies")) == pytest.approx(gate.threshold(scored.select("distance", F.explode(F.expr("sequence(1, copies)")))))
