"""Drain as a stream, the tail source, and the functions from SQL."""

import random

import pytest
from pyspark.sql import functions as F

from logweave.functions import sql
from logweave.operators import mining
from logweave.sources.tail import TailReader, TailSource
from logweave.streaming import drain, online


def plain_pass(lines):
    """cluster id by masked line, and [template, size, first, last] by id: one pass over all lines, no index."""
    leaves, home, clusters = {}, {}, {}
    for seq, line in lines:
        if line not in home:
            tokens = line.split()
            key = (len(tokens), *(mining.WILD if any(c.isdigit() for c in t) else t for t in tokens[: mining.DEPTH]))
            scored = [(sum(a == b for a, b in zip(clusters[c][0], tokens)), -i, c) for i, c in enumerate(leaves.setdefault(key, []))]
            if scored and max(scored)[0] >= mining.SIMILARITY * len(tokens) and tokens:
                home[line] = max(scored)[2]
                old = clusters[home[line]][0]
                clusters[home[line]][0] = [a if a == b else mining.WILD for a, b in zip(old, tokens)]
            else:
                home[line] = seq
                leaves[key].append(seq)
                clusters[seq] = [tokens, 0, seq, seq]
        clusters[home[line]][1] += 1
        clusters[home[line]][3] = seq
    return home, {c: (" ".join(t), n, a, z) for c, (t, n, a, z) in clusters.items()}


def log_lines(n, seed=3):
    r = random.Random(seed)
    words = ["get", "put", "disk", "user", "ok", "slow", "x", "y", "z"]
    return [(i, " ".join(r.choice(words) for _ in range(r.choice((1, 3, 3, 4, 6))))) for i in range(n)]


def test_batch_clusters_equal_one_plain_pass(spark):
    lines = log_lines(400)
    home, clusters = plain_pass(lines)
    got = mining.mine(spark.createDataFrame(lines, "seq long, raw string").repartition(5))
    assert {r["masked"]: r["cluster_id"] for r in got.collect()} == home
    view = {r["cluster_id"]: (r["template"], r["size"], r["has_rule"]) for r in mining.template_view(got, 1000, got.where("cluster_id = 0").select("cluster_id")).collect()}
    assert view == {c: (t, n, c == 0) for c, (t, n, *_) in clusters.items()}
    stats = mining.mining_stats(got, got.where("cluster_id = 0").select("cluster_id")).first()
    assert (stats["clusters"], stats["mined"], stats["rules_learned"]) == (len(clusters), 400, 1)
    with_ids = mining.with_clusters(spark.createDataFrame(lines, "seq long, raw string"), got)
    assert {r["seq"]: r["cluster_id"] for r in with_ids.collect()} == {i: home[x] for i, x in lines}


def test_a_stream_of_three_batches_has_the_clusters_of_one_pass(spark, tmp_path):
    lines = log_lines(240, 8)
    home, clusters = plain_pass(lines)
    source, got = tmp_path / "in", {}
    source.mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for a, b in ((0, 90), (90, 150), (150, 240)):
            spark.createDataFrame(lines[a:b], "seq long, raw string").coalesce(1).write.mode("append").parquet(str(source))
            stream = drain.clusters_of(spark.readStream.schema("seq long, raw string").parquet(str(source)))
            sink = lambda df, i: got.update({r["masked"]: r["cluster_id"] for r in df.collect()})
            stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).outputMode("update").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
        assert got == home
        view = drain.cluster_view(spark, str(tmp_path / "c")).collect()
        assert {r["cluster_id"]: (r["template"], r["size"], r["first_seq"], r["last_seq"]) for r in view} == clusters
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_tail_numbers_lines_and_goes_on_after_a_restart(spark, tmp_path):
    log, got = tmp_path / "app.log", []
    log.write_text("one\n\ntwo\r\nthree\npart")
    spark.dataSource.register(TailSource)

    def drained():
        stream = spark.readStream.format("logtail").option("path", str(log)).option("batch_lines", 2).load()
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, i: got.extend(tuple(r) for r in df.collect())).start()
        query.processAllAvailable()
        query.stop()
        return sorted(got)

    assert drained() == [(0, "one"), (1, "two"), (2, "three")]
    with log.open("a") as f:
        f.write("ly\nfour\n")
    assert drained() == [(0, "one"), (1, "two"), (2, "three"), (3, "partly"), (4, "four")]
    reader = TailReader({"path": str(log), "batch_lines": "3"})
    rows, end = reader.read({"byte": 0, "seq": 0})
    rows = list(rows)
    assert rows == list(reader.readBetweenOffsets({"byte": 0, "seq": 0}, end)) and len(rows) == 3
    assert list(TailReader({"path": str(log)}).read({"byte": 10_000, "seq": 9})[0])[0] == (9, "one")
    assert TailReader({"path": str(log), "start": "end"}).initialOffset()["byte"] == log.stat().st_size
    with pytest.raises(ValueError):
        TailReader({})


def test_tailed_lines_feed_the_cascade(spark, tmp_path):
    log, got = tmp_path / "a.log", []
    log.write_text("2025-01-01,INFO,all is well,s\n2025-01-01,ERROR,all is bad,s\n")
    spark.dataSource.register(TailSource)
    stream = spark.readStream.format("logtail").option("path", str(log)).load()
    query = online.run(stream, F.lit("2026-01-05 00:00:00").cast("timestamp"), str(tmp_path / "c"), lambda df, i: got.extend(df.select("seq", "mode").collect()))
    query.processAllAvailable()
    query.stop()
    assert sorted((r["seq"], r["mode"]) for r in got) == [(0, "Discovery"), (1, "Cached")]


def test_functions_from_sql_are_those_of_the_engine(spark):
    sql.register(spark)
    spark.createDataFrame([(1, 'a=1 b="x y" a=2\n\n{"k": [1], "n": null}'), (2, None), (3, "10.0.0.1 Failed password at 2025-01-01 10:00:00")], "id int, text string").createOrReplaceTempView("texts")
    assert [tuple(r) for r in spark.sql("select id, line_no from texts, lateral log_split(text) order by all").collect()] == [(1, 0), (1, 2), (3, 0)]
    fields = spark.sql("select line_no, k, v from (select line_no, line from texts, lateral log_split(text) where id = 1), lateral log_fields(line) order by all").collect()
    assert [tuple(r) for r in fields] == [(0, "a", "1"), (0, "b", "x y"), (2, "k", "[1]")]
    assert tuple(spark.sql("select log_mask(text), log_ip(text), log_event(text), log_severity('[warn]'), log_severity('?') from texts where id = 3").first()) == ("IP Failed password at TS", "10.0.0.1", "auth_failure", "warning", "unknown")
