"""Sinks, kept state, the stream, readers and the reports' small functions."""

import json

from pyspark.sql import functions as F

from logweave.operators import gate, reports, tiers
from logweave.sources import commits, corpus, readers
from logweave.streaming import online

NOW = "2026-01-05 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def test_state_is_kept_replaced_and_cleared(spark, tmp_path):
    path = str(tmp_path)
    assert readers.load_state(spark, path, "families", online.FAMILIES).count() == 0
    one = spark.createDataFrame([("json", ("json", None, "s", "heuristic"))], online.FAMILIES)
    readers.save_state(one, path, "families")
    readers.save_state(readers.load_state(spark, path, "families", online.FAMILIES).unionByName(one.withColumn("family", F.lit("csv"))), path, "families")
    assert {r["family"] for r in readers.load_state(spark, path, "families", online.FAMILIES).collect()} == {"json", "csv"}
    for expected in (2, 0):
        assert {r["table"]: r["cleared"] for r in readers.clear_state(spark, path).collect()}["families"] == expected


def test_a_stream_learns_once_forgets_old_templates_and_discovers_again_after_clearing(spark, tmp_path):
    source, state, got = tmp_path / "in", str(tmp_path / "state"), []
    source.mkdir()
    schema = "seq long, raw string"

    def feed(name, lines):
        (source / f"{name}.json").write_text("\n".join(json.dumps({"seq": i, "raw": x}) for i, x in lines))

    def drain():
        got.clear()
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        online.run(stream, now(), str(tmp_path / "checkpoint"), lambda df, i: got.extend(df.select("seq", "mode", "severity").collect()), once=True, state=state).awaitTermination()
        return {r["seq"]: r["mode"] for r in got}

    feed("a", [(1, "2025-01-01,INFO,all is well,s"), (2, "2025-01-01,ERROR,all is bad,s"), (3, "word")])
    assert drain() == {1: "Discovery", 2: "Cached", 3: "Discovery"}
    feed("b", [(4, "2025-01-02,INFO,again,s"), (5, "another word"), (6, '{"a": 1}')])
    assert drain() == {4: "Cached", 5: "Cached", 6: "Discovery"}
    kept = readers.load_state(spark, state, "templates", online.TEMPLATES)
    assert kept.count() == 3 and {r["family"] for r in readers.load_state(spark, state, "families", online.FAMILIES).collect()} == {"csv", "json", "generic"}
    later = F.lit("2026-02-05 00:00:00").cast("timestamp")
    assert readers.upsert_rules(kept, kept.limit(0), later).count() == 0
    readers.clear_state(spark, state)
    feed("c", [(7, "2025-01-03,INFO,afresh,s")])
    assert drain() == {7: "Discovery"}


def test_tail_counts_and_windows(spark, tmp_path):
    (tmp_path / "x.log").write_text("one\n\ntwo\n")
    query = readers.read_tail(spark, str(tmp_path)).writeStream.format("memory").queryName("tailed").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["line"] for r in spark.table("tailed").collect()} == {"one", "two"}
    rows = spark.createDataFrame([("2026-01-01 10:05:00", "info"), ("2026-01-01 10:55:00", "info"), ("2026-01-01 11:05:00", "error")], "t string, severity string").withColumn("ts", F.col("t").cast("timestamp"))
    assert sorted(r["n"] for r in online.counts_by_window(rows).collect()) == [1, 2]


def test_files_are_read_in_their_order_and_limits_hold(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"line {i}" for i in range(2500)))
    got = readers.read_lines(spark, str(tmp_path / "a.txt"), batch_lines=1000)
    by_batch = {}
    for r in got.collect():
        by_batch.setdefault(r["batch_id"], {})[r["line_no"]] = r["line"]
    flat = [b[i] for b in sorted(by_batch.values(), key=lambda b: int(b[min(b)].split()[1])) for i in sorted(b)]
    assert flat == [f"line {i}" for i in range(2500)] and max(map(len, by_batch.values())) <= 1000
    lines = spark.createDataFrame([(1, i, "a") for i in range(1001)] + [(2, 0, "b" * 10_001), (3, 0, "c"), (4, 0, "d" * 10_000)], "batch_id long, line_no long, line string")
    ok, refused = readers.within_limits(lines)
    assert {r["batch_id"] for r in ok.collect()} == {3, 4} and {r["batch_id"] for r in refused.collect()} == {1, 2}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("json", 1, "a"), ("csv", 2, "b")], "family string, seq int, raw string")
    readers.write_records(rows, f"{tmp_path}/r")
    readers.write_records(rows, f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").where("family = 'csv'").count() == 2
    readers.write_ndjson(rows, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    runs = spark.createDataFrame([(i, f"2026-01-0{i}", b) for i, b in ((1, 10), (2, 10), (3, 10), (4, 10))], "id int, at string, bytes long")
    assert {r["id"] for r in readers.newest_runs(runs, most_bytes=25).collect()} == {4, 3}
    assert {r["id"] for r in readers.newest_runs(runs, most_bytes=5).collect()} == {4}


def test_gate_is_saved_only_when_good_and_open_without_a_model(spark, tmp_path):
    lines = corpus.make_corpus(spark, 30, {k: corpus.KNOWN[k] for k in ("cef", "logfmt", "python_logging")}).select(F.col("seq").alias("id"), "label", F.col("raw").alias("text"))
    assert {r["label"]: r["count"] for r in lines.groupBy("label").count().collect()} == {"cef": 30, "logfmt": 30, "python_logging": 30}
    model = gate.fit_families(lines)
    assert gate.predict(model, lines).where("family_guess = label").count() >= 86
    assert not readers.save_gate(model, f"{tmp_path}/bad", 0.5, 1.0, 0.1) and readers.load_gate(f"{tmp_path}/bad")[0] is None
    assert readers.save_gate(model, f"{tmp_path}/good", 0.99, 0.95, 0.1) and readers.load_gate(f"{tmp_path}/good")[1] is None
    loaded, reason = readers.load_gate(f"{tmp_path}/good", version=3)
    assert loaded is None and "version" in reason


def test_novelty_equals_plain_nearest_neighbours(spark):
    import numpy as np

    known, asked = ["alpha beta", "alpha gamma", "beta gamma", "alpha beta", "delta"], ["alpha beta", "zeta eta", "gamma", "delta alpha"]
    rows = spark.createDataFrame([(t, "k") for t in known], "text string, label string")
    fitted = gate.Novelty(rows, limit=0.5)
    got = {r["text"]: r["distance"] for r in fitted.score(spark.createDataFrame([(t,) for t in asked], "text string")).collect()}

    def grams(t):
        return [p[i : i + n] for w in t.split() for p in [f" {w} "] for n in (2, 3, 4) for i in range(max(len(p) - n + 1, 1))]

    df = {}
    for t in known:
        for g in set(grams(t)):
            df[g] = df.get(g, 0) + 1
    terms = sorted(g for g in df if df[g] >= 2)

    def vector(t):
        n = np.array([grams(t).count(g) for g in terms], float)
        v = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0) * (np.log((1 + len(known)) / (1 + np.array([df[g] for g in terms]))) + 1)
        return v / np.linalg.norm(v) if v.any() else v

    for t in asked:
        v = vector(t)
        d = sorted(2**0.5 if not vector(k).any() else np.linalg.norm(v - vector(k)) for k in known)[:3]
        assert abs(got[t] - (np.mean(d) if v.any() else 1.0)) < 1e-6, t


def test_reports_on_small_tables(spark):
    rows = spark.createDataFrame([(i, m, f, x) for i, (m, f, x) in enumerate([("Cached", "a", 1.0), ("Discovery", "a", 2.0), ("Error", "b", 6.0)])], "seq long, mode string, family string, latency_ms double").withColumn("format", F.col("family"))
    got = {(r["kind"], r["name"]): r["value"] for r in reports.run_summary(rows).collect()}
    assert got[("total", None)] == 3 and got[("avg_latency_ms", None)] == 3.0 and got[("mode", "Error")] == 1 and got[("family", "a")] == 2
    empty = {(r["kind"], r["name"]): r["value"] for r in reports.run_summary(rows.limit(0)).collect()}
    assert empty == {("total", None): 0.0, ("avg_latency_ms", None): 0.0}
    assert reports.console(rows.limit(0)).first()["saved_pct"] == 0
    maps = spark.createDataFrame([({"a": "1", "b": ""}, {"a": "2", "raw_message": "x"}, 2, None), ({}, {}, None, "odd")], "extracted map<string,string>, extra map<string,string>, quarantine_count int, llm_error string").withColumn("graduate_after", F.lit(8))
    assert [r["f"] for r in maps.select(reports.flat_fields().alias("f")).collect()] == [{"a": "2"}, {}]
    assert [r["n"] for r in maps.select(reports.note().alias("n")).collect()] == ["Held for review: seen 2 of 8 times", "odd"]
    health = tiers.health(tiers.decide(rows.select("seq", F.lit("CEF:0|a|b|1|1|n|1|").alias("raw")), now()), gate_reason="none").first()
    assert health["families"] == ["cef"] and not health["gate_loaded"]


def test_a_batch_that_failed_after_the_sink_leaves_one_copy_and_committed_ones_are_left_alone(spark, tmp_path, monkeypatch):
    import pytest

    state, out = str(tmp_path / "state"), str(tmp_path / "out")
    schema = "seq long, family string, mode string"
    sink = lambda i: lambda df: readers.write_records(df.select("seq", "family", "mode"), out, batch=i)
    lines = lambda *rows: spark.createDataFrame(rows, "seq long, raw string")
    first = lines((1, "2025-01-01,INFO,all is well,s"), (2, "2025-01-01,ERROR,all is bad,s"))
    commit = commits.commit
    monkeypatch.setattr(commits, "commit", lambda *a: (_ for _ in ()).throw(OSError("crashed")))
    with pytest.raises(OSError):
        online.online(first, now(), state, sink(0), 0)
    assert commits.last_batch(spark, state) is None and commits.read_batches(spark, out, schema).count() == 2
    monkeypatch.setattr(commits, "commit", commit)
    for _ in range(2):  # the batch again, then once more after it was committed
        online.online(first, now(), state, sink(0), 0)
    online.online(lines((3, "2025-01-01,INFO,again,s"), (4, None)), now(), state, sink(1), 1)
    assert sorted((r["seq"], r["mode"]) for r in commits.read_batches(spark, out, schema).collect()) == [(1, "Discovery"), (2, "Cached"), (3, "Cached"), (4, "Error")]
    assert commits.last_batch(spark, state) == 1 and readers.load_state(spark, state, "stats", online.STATS).first()["mined"] == 1


def test_a_crash_in_the_swap_leaves_the_old_rules(spark, tmp_path, monkeypatch):
    import pytest

    path = str(tmp_path)
    one = spark.createDataFrame([("json", ("json", None, "s", "heuristic"))], online.FAMILIES)
    readers.save_state(one, path, "families")
    write = commits.Store.write_once
    monkeypatch.setattr(commits.Store, "write_once", lambda *a: (_ for _ in ()).throw(OSError("crashed")))
    with pytest.raises(OSError):
        readers.save_state(one.withColumn("family", F.lit("csv")), path, "families")
    assert [r["family"] for r in readers.load_state(spark, path, "families", online.FAMILIES).collect()] == ["json"]
    monkeypatch.setattr(commits.Store, "write_once", lambda *a: False)
    with pytest.raises(RuntimeError, match="another"):
        readers.save_state(one, path, "families")
    monkeypatch.setattr(commits.Store, "write_once", write)
    for name in ("csv", "cef", "leef", "ncsa"):
        readers.save_state(one.withColumn("family", F.lit(name)), path, "families")
        assert [r["family"] for r in readers.load_state(spark, path, "families", online.FAMILIES).collect()] == [name]
    assert len(commits.Store(spark, path).names("families")) <= commits.KEPT + 1 and len(commits.Store(spark, path).names("_commits")) == commits.KEPT


def test_counters_of_held_back_records_go_on_from_batch_to_batch(spark, tmp_path):
    novel = lambda texts: texts.select("masked", F.lit(True).alias("novel"), F.lit(0.9).alias("distance"), F.lit("x").alias("family_guess"))
    lines, got = [(i, f"odd thing number {i % 2}") for i in range(12)], {}
    for i, (a, b) in enumerate(((0, 3), (3, 7), (7, 12))):
        batch = spark.createDataFrame(lines[a:b], "seq long, raw string")
        online.online(batch, now(), str(tmp_path), lambda df: got.update({r["seq"]: (r["mode"], r["quarantine_count"], r["occurrences"]) for r in df.select("seq", "mode", "quarantine_count", "occurrences").collect()}), i, gate=novel, enforce=True, graduate_repeats=5)
    whole = tiers.decide(spark.createDataFrame(lines, "seq long, raw string"), now(), gate=novel, enforce=True, graduate_repeats=5, quarantine=tiers.Quarantine())
    want = {r["seq"]: (r["mode"], r["quarantine_count"], r["occurrences"]) for r in whole.collect()}
    assert got == want and got[6] == ("Quarantined", 7, 4) and got[7][0] == "Discovery" and got[8] == ("Cached", None, None)
    assert readers.load_state(spark, str(tmp_path), "q_lines", online.STATE).count() == 2


def test_providers_are_asked_for_deciding_records_in_a_stream_too(spark, tmp_path):
    asked, got = [], []
    provider = lambda line: asked.append(line) or '{"method": "delimiter", "delimiter": "|"}'
    for i, rows in enumerate(([(1, "a b | c"), (2, "d e | f")], [(3, "g h | i"), (4, '{"a": 1}')])):
        online.online(spark.createDataFrame(rows, "seq long, raw string"), now(), str(tmp_path), lambda df: got.extend(df.select("seq", "mode", "inferred_by", "llm_error").collect()), i, providers={"one": provider})
    got = {r["seq"]: r for r in got}
    assert asked == ["a b | c", '{"a": 1}'] and got[1]["inferred_by"] == got[2]["inferred_by"] == got[3]["inferred_by"] == "llm"
    assert got[3]["mode"] == "Cached" and got[4]["inferred_by"] == "heuristic" and "lacks" in got[4]["llm_error"] and got[3]["llm_error"] is None


def test_totals_sum_what_batches_observe(spark, tmp_path):
    import time

    source, got = tmp_path / "in", []
    source.mkdir()
    for n in range(3):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"seq": 10 * n + i, "raw": "CEF:0|a|b|1|1|n|1|" if i else None}) for i in range(n + 1)))
    totals = online.Totals()
    spark.streams.addListener(totals)
    stream = spark.readStream.schema("seq long, raw string").option("maxFilesPerTrigger", 1).json(str(source))
    online.run(stream, now(), str(tmp_path / "c"), lambda df, i: got.extend(df.select("seq").collect()), once=True).awaitTermination()
    for _ in range(50):
        if totals.sums["lines"] == 6:
            break
        time.sleep(0.2)
    spark.streams.removeListener(totals)
    assert dict(totals.sums) == {"lines": 6, "without_text": 3} and len(got) == 6


def test_a_full_run_store_keeps_the_first_records_of_the_newest_run(spark):
    records = spark.createDataFrame([(r, i, "x") for r in (1, 2) for i in range(6)], "id long, seq long, raw string")
    runs = spark.createDataFrame([(1, "2026-01-01", 10), (2, "2026-01-02", 90)], "id long, at string, bytes long")
    assert sorted((r["id"], r["seq"]) for r in readers.trimmed_runs(records, runs, 50, 3).collect()) == [(2, 0), (2, 1), (2, 2)]
    assert readers.trimmed_runs(records, runs, 100, 3).count() == 12


def test_a_file_of_one_row_group_is_spread_over_all_tasks(spark, tmp_path, monkeypatch):
    from logweave.sources import shared

    spark.range(40_000).coalesce(1).write.option("parquet.block.size", 1 << 30).parquet(f"{tmp_path}/t")
    monkeypatch.setattr(shared, "TASK_ROWS", 2000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        scan = spark.read.parquet(f"{tmp_path}/t")
        sizes = lambda df: [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert scan.rdd.getNumPartitions() >= 8 and len(sizes(scan)) == 1  # many splits, one with rows
        got = sizes(shared.spread(scan))
        assert sum(got) == 40_000 and len(got) == 20 and max(got) <= 2200
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
