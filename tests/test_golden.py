"""Behaviour of parsing, normalising, assembling and the tiers on single lines of every format."""

import json

import pytest
from pyspark.sql import functions as F

from logweave.functions.text import clean
from logweave.functions.timestamps import from_epoch, parse_ts, render
from logweave.operators import assemble, discovery, rules, tiers
from logweave.operators.normalize import normalize
from logweave.operators.parse import parse
from logweave.plans import catalog
from logweave.sources import readers

NOW = "2026-01-05 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def own_rules(spark, lines):
    """Each line normalised by the rule it would give itself."""
    rows = spark.createDataFrame(list(enumerate(lines)), "seq long, raw string")
    rows = rules.with_rule(rules.with_family(rows, now()), now())
    rows = rows.select("seq", "raw", "family", F.col("own_rule.method").alias("method"), F.col("own_rule.delimiter").alias("delimiter"), F.col("own_rule.signature").alias("format"))
    return [r.asDict() for r in normalize(parse(rows, now()), now()).orderBy("seq").collect()]


LONG = "x" * 9000
#: line: what its record has at least; keys other than columns are of extra.
CASES = {
    '{"level":"warn","ts":1700000000,"msg":"hello","host":"h9","event":"logon","deep":{"a":1}}': {"family": "json", "severity": "warning", "message": "hello", "source": "h9", "event_type": "logon", "timestamp": "2023-11-14T22:13:20Z", "deep": '{"a":1}'},
    '{"severity": 3, "msg": "m"}': {"severity": "error"},
    '{"severity": [1], "msg": "m"}': {"severity": "unknown"},
    '{"level": "chatty", "msg": "m"}': {"severity": "unknown", "severity_raw": "chatty"},
    '{"t":{"$date":"2025-03-01T10:00:00Z"},"s":"I","c":"STORAGE","msg":"opened"}': {"timestamp": "2025-03-01T10:00:00Z", "severity": "info", "source": "STORAGE"},
    json.dumps({"log": "2025-09-19 14:32:10.123 [main] INFO org.demo.App - up\n", "stream": "stdout", "time": "2025-09-19T14:32:10.5Z"}): {"format": "JSON Object", "timestamp": "2025-09-19T14:32:10.123000Z", "source": "org.demo.App", "message": "up", "stream": "stdout"},
    "2025-09-13T10:15:30Z,ERROR,Connection lost by peer,app-2,pid=992": {"family": "csv", "timestamp": "2025-09-13T10:15:30Z", "severity": "error", "message": "Connection lost by peer", "source": "app-2", "pid": "992"},
    '2025-09-13T10:15:30Z,INFO,"said ""so, then"" again",app-2': {"message": 'said "so, then" again', "source": "app-2"},
    f'2025-09-13T10:15:30Z,INFO,"{LONG}",a': {"message": LONG, "source": "a"},
    f"2025-09-13T10:15:30Z,INFO,{LONG},a b": {"source": LONG, "message": "a b"},
    "2025-09-13T10:20:00Z | CRITICAL | Payments | order o-77 failed after 3000ms": {"family": "pipe", "severity": "critical", "source": "Payments", "message": "order o-77 failed after 3000ms"},
    "one | two words | three": {"field_0": "one", "field_1": "two words", "message": "one | two words | three"},
    "a;b;c": {"family": "semicolon"},
    "x\ty\tz": {"family": "tab"},
    "Oct 11 22:14:15 box su: 'su root' failed for lon": {"family": "rfc3164", "source": "box", "program": "su"},
    "<134>Oct 11 22:14:15 box app[42]: hello": {"severity": "info", "source": "box", "pid": "42", "timestamp": "2025-10-11T22:14:15Z"},
    "[ERROR] disk is full": {"severity": "error", "message": "disk is full"},
    "2025-09-13 [main] ERROR c.f.Bar - boom": {"severity": "error"},
    '(status=OK) user="jane doe" n=5': {"status": "OK", "user": "jane doe", "n": "5"},
    '1.2.3.4 - eve [19/Sep/2025:13:24:00 +0200] "GET /i.html HTTP/1.1" 404 4321 "https://e.org" "M/5"': {"format": "NCSA Combined / Web Access Log", "timestamp": "2025-09-19T11:24:00Z", "source": "1.2.3.4", "event_type": "http_request", "severity": "warning", "http_status": "404", "user": "eve", "bytes_sent": "4321", "http_method": "GET"},
    "2025-09-19 14:32:10.123 [main] INFO org.demo.Start - Started in 2.5s": {"format": "Java Application / Log4j / Spring Boot", "timestamp": "2025-09-19T14:32:10.123000Z", "source": "org.demo.Start", "message": "Started in 2.5s", "thread": "main"},
    "2025-09-19 14:32:10,123 WARN  [o.d.Pool] (pool_1) - slow": {"family": "java", "severity": "warning", "source": "o.d.Pool", "message": "slow"},
    "INFO:root:connected": {"format": "Python Standard Logger", "severity": "info", "source": "root", "message": "connected"},
    "2025-09-19 14:32:10,123 - jobs.run - WARNING - late": {"severity": "warning", "source": "jobs.run", "message": "late"},
    "[2025-09-19 14:32:10,123] {jobs.py:7} ERROR - late": {"severity": "error", "source": "jobs.py:7", "caller": "jobs.py:7"},
    "2025-09-19T14:32:10.123456789Z stdout F Serving on :8080": {"family": "cri", "timestamp": "2025-09-19T14:32:10.123456Z", "severity": "info", "message": "Serving on :8080", "stream": "stdout"},
    '2025-09-19T14:32:10.5Z stderr F {"msg":"inner","severity":"debug"}': {"message": "inner", "severity": "debug", "stream": "stderr"},
    '2025/09/19 14:32:10 [error] 1234#0: *1 open() "/f.ico" failed, client: 10.0.0.9, server: s': {"source": "nginx", "severity": "error", "message": 'open() "/f.ico" failed', "client": "10.0.0.9", "server": "s"},
    "<165>1 2025-09-19T14:32:10.003Z m.example.org ev 1234 ID47 - an entry": {"severity": "info", "source": "m.example.org", "event_type": "ID47", "message": "an entry", "program": "ev", "facility": "20"},
    '<165>1 2025-09-19T14:32:10Z m ev - ID47 [x@1 a="b"] an entry': {"structured_data": '[x@1 a="b"]', "message": "an entry"},
    "CEF:0|Vendor|Wall|1.0|100|Packet dropped|5|src=10.0.0.1 msg=two words a\\=b dpt=80": {"source": "Vendor Wall", "event_type": "100", "message": "Packet dropped", "severity": "info", "src": "10.0.0.1", "dpt": "80", "msg": "two words a=b"},
    f"CEF:0|V|W|1|1|n|5|msg={LONG[:8000]} note=a\\=b{'c ' * 300}": {"family": "cef", "msg": LONG[:8000], "note": ("a=b" + "c " * 300).strip()},
    "LEEF:1.0|V|W|2|77|src=1.1.1.1\tmsg=two words\tdst=2.2.2.2": {"family": "leef", "event_type": "77", "src": "1.1.1.1", "dst": "2.2.2.2"},
    'ts=2025-09-19T14:32:10.123Z level=error caller=m.go:42 msg="it broke" err="null pointer" id=9': {"format": "Logfmt / Key-Value Stream", "severity": "error", "source": "m.go:42", "message": "it broke", "err": "null pointer"},
    "2025-09-19 14:32:10.5 UTC [77] app@db ERROR:  statement: SELECT 1": {"family": "postgres", "source": "postgres", "severity": "error", "event_type": "db_query", "user_database": "app@db"},
    "\x1b[32m2025-09-19 14:32:10.123 [main] INFO org.demo.App - Coloured\x1b[0m": {"severity": "info", "message": "Coloured"},
    "Failed password for invalid user adm from 192.168.1.105 port 54321 ssh2": {"event_type": "auth_failure", "severity": "warning", "source": "192.168.1.105", "ip": "192.168.1.105", "port": "54321", "user": "adm"},
    f'note="{LONG}" n=1 it\'s fine': {"note": LONG, "n": "1"},
    f"q='{LONG[:3000]}\\'{LONG[:3000]}' n=2": {"n": "2"},
    "": {"family": "generic", "severity": "unknown"},
}
COLUMNS = ("family", "format", "timestamp", "source", "event_type", "severity", "message")


def test_records_of_every_format(spark):
    got = own_rules(spark, list(CASES))
    wrong = []
    for (line, expected), r in zip(CASES.items(), got):
        for key, value in expected.items():
            shown = r[key] if key in COLUMNS else r["extra"].get(key)
            if shown != value:
                wrong.append((line[:60], key, value[:60] if value else value, shown[:60] if shown else shown))
    assert not wrong, wrong


def test_timestamps(spark):
    given = {
        "2025-09-13T10:00:00": "2025-09-13T10:00:00Z", "2025-09-13T10:00:00+05:30": "2025-09-13T04:30:00Z", "2025-09-13 10:00:00.250": "2025-09-13T10:00:00.250000Z", "13/Sep/2025:10:00:00 -0100": "2025-09-13T11:00:00Z",
        "Dec 30 10:00:00": "2025-12-30T10:00:00Z", "Jan 4 10:00:00": "2026-01-04T10:00:00Z", "Feb 29 10:00:00": None, "12 users connected": None, "10:15:32 ERROR x": None, "20250913": None, "": None,
        "1700000000": "2023-11-14T22:13:20Z", "1700000000123": "2023-11-14T22:13:20.123000Z", "1700000000123456": "2023-11-14T22:13:20.123456Z", "1700000000123456789": "2023-11-14T22:13:20.123456Z", "1700000000.5": "2023-11-14T22:13:20.500000Z",
        "02 May 2025 10:00:00": "2025-05-02T10:00:00Z", "MAY 2 2025 10:00": "2025-05-02T10:00:00Z", '"2025-09-13T10:00:00Z\n"': "2025-09-13T10:00:00Z", "2025-13-13T10:00:00Z": None,
        '{"$date":"2025-03-01T10:00:00Z"}': "2025-03-01T10:00:00Z", "2025-09-13 10:00:00,123": "2025-09-13T10:00:00.123000Z",
    }
    rows = spark.createDataFrame(list(enumerate(given)), "i int, s string").select("i", render(parse_ts(F.col("s"), now())).alias("iso")).orderBy("i").collect()
    assert [r["iso"] for r in rows] == list(given.values())
    numbers = [(1.7e9, "2023-11-14T22:13:20Z"), (1.7e12, "2023-11-14T22:13:20Z"), (1.7e15, "2023-11-14T22:13:20Z"), (1.7e18, "2023-11-14T22:13:20Z"), (5.0, None), (None, None)]
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(numbers)], "i int, v double").select("i", render(from_epoch(F.col("v"))).alias("iso")).orderBy("i").collect()
    assert [r["iso"] for r in rows] == [x for _, x in numbers]
    assert spark.createDataFrame([("\x1b[1;31m red \x1b[0m",)], "s string").select(clean(F.col("s"))).first()[0] == "red"


def assembled(spark, lines):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "batch_id long, line_no long, line string")
    return [r["raw"] for r in assemble.assemble(rows).orderBy("rec_no").collect()]


def test_assembly(spark):
    lines = ["{", '  "level": "error",', '  "message": "boom"', "}", "Traceback (most recent call last):", '  File "t.py", line 1', "ValueError: boom", "Caused by: that", '{"a": "open', "b", "alone 1", "", "alone 2"]
    got = assembled(spark, lines)
    assert len(got) == 6 and json.loads(got[0])["message"] == "boom" and got[1].endswith("Caused by: that") and got[-2:] == ["alone 1", "alone 2"]
    long_ = ['m="' + "y" * 9900 + '"', ' k="' + '\\"' * 4900 + '"', 'open {"k": "' + "{" * 9000]
    assert assembled(spark, long_) == ["\n".join(long_[:2]), long_[2]]
    many = ["{", *(f"line {i}" for i in range(1200)), "}"]
    got = assembled(spark, many)
    assert max(x.count("\n") + 1 for x in got) == assemble.MOST_LINES and "\n".join(got) == "\n".join(many)


def decided(spark, lines, **options):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq long, raw string")
    return [r.asDict(True) for r in tiers.decide(rows, now(), **options).orderBy("seq").collect()]


def test_modes_errors_and_stored_rules(spark):
    lines = ['{"a": 1}', "word", None, "bad", '{"b": 2}', "other word", "2025-01-01,INFO,m m,s"]
    got = decided(spark, lines, failed=F.when(F.col("raw") == "bad", "ValueError: boom"))
    assert [r["mode"] for r in got] == ["Discovery", "Discovery", "Error", "Error", "Cached", "Cached", "Discovery"]
    assert [r["error"] for r in got][2:4] == ["no text", "ValueError: boom"] and got[4]["rule"] == got[0]["rule"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq long, raw string")
    shown = [r.asDict() for r in tiers.process(tiers.decide(rows, now(), failed=F.when(F.col("raw") == "bad", "ValueError: boom")), now()).orderBy("seq").collect()]
    assert (shown[3]["format"], shown[3]["severity"], shown[3]["message"], shown[3]["raw"], shown[3]["extra"]) == ("n/a", "unknown", None, "bad", {})
    assert shown[0]["format"] == "JSON Object" and shown[6]["message"] == "m m"
    assert decided(spark, []) == []
    llm = spark.createDataFrame([("json", ("json", None, "x", "llm"))], f"family string, rule {tiers.RULE}")
    assert [r["tier"] for r in decided(spark, lines[:1], known=llm)] == ["family"]
    old = spark.createDataFrame([("json", ("json", None, "old", "heuristic")), ("csv", ("delimiter", ",", "old", "llm"))], llm.schema)
    new = spark.createDataFrame([("json", ("json", None, "new", "llm")), ("csv", ("delimiter", ",", "new", "llm")), ("generic", ("compositional", None, "g", "heuristic"))], llm.schema)
    assert {r["family"]: r["rule"]["signature"] for r in tiers.replace_rules(old, new).collect()} == {"json": "new", "csv": "old"}


def held_back(lines, after, repeats):
    """Mode of every record of one family, all novel, one by one."""
    out, templates, texts, ruled = [], {}, {}, False
    for line, template in lines:
        if ruled:
            out.append("Cached")
            continue
        templates[template], texts[line] = templates.get(template, 0) + 1, texts.get(line, 0) + 1
        ruled = templates[template] >= after or texts[line] >= repeats
        out.append("Discovery" if ruled else "Quarantined")
    return out


@pytest.mark.parametrize(("after", "repeats"), [(3, 5), (8, 2), (50, 50)])
def test_novel_formats_are_held_back_until_they_have_been_seen_often_enough(spark, after, repeats):
    lines = [f"<Event {'abc'[i % 3]}> n {i}" for i in range(9)] + ["<Event a> n 3"] * 3 + [f"<Event d> n {i}" for i in range(9)]
    gate = lambda masked: masked.select("masked", F.lit(True).alias("novel"), F.lit(1.5).alias("distance"), F.lit("none").alias("family_guess"))
    got = decided(spark, lines, gate=gate, enforce=True, graduate_after=after, graduate_repeats=repeats)
    import re

    assert [r["mode"] for r in got] == held_back([(x, re.sub(r"\b\d+\b", "NUM", x)) for x in lines], after, repeats)
    assert all(r["mode"] == "Discovery" for r in decided(spark, lines[:1], gate=gate))
    assert got[0]["novel"] and got[0]["distance"] == 1.5 and got[0]["quarantine_count"] == 1


def test_templates_teach_later_runs(spark):
    rows = spark.createDataFrame([(0, "job 17 done"), (1, "job 18 done")], "seq long, raw string")
    first = tiers.decide(rows, now())
    kept = tiers.learned_templates(first, now())
    assert kept.count() == 1 and [r["mode"] for r in first.orderBy("seq").collect()] == ["Discovery", "Cached"]
    again = tiers.decide(rows, now(), templates=kept)
    assert [r["tier"] for r in again.orderBy("seq").collect()] == ["template", "fingerprint"]
    assert tiers.tier_stats(again).first().asDict() == {"mined": 1, "template_rule_hits": 1, "novel_templates": 0, "graduated_now": 0, "kv_backed_rules": 1, "escalated": 0}
    assert tiers.learned_templates(again, now()).count() == 0 and tiers.cache_view(again, now()).count() == 1


def test_replies_of_a_provider():
    assert discovery.reply_object('so {"a": 1} and {"method": "json"} end {"b": 2}') == {"method": "json"}
    assert discovery.checked_rule('```json\n{"method": "delimiter", "delimiter": "|"}\n```', "a | b | c", False, "s")[0]["signature"] == "Pipe-Delimited"
    for bad in ("", "nothing", '{"method": "magic"}', '{"method": "json"}', '{"method": "delimiter", "delimiter": "#"}', '{"method": "delimiter", "delimiter": ","}'):
        rule, error = discovery.checked_rule(bad, "a | b", False, "s")
        assert rule is None and error


def test_denied_and_failing_providers_leave_the_heuristic_rule(spark):
    firsts = spark.createDataFrame([("pipe", "a | b | c", ("delimiter", "|", "own", "heuristic")), ("csv", "a,b,c", ("delimiter", ",", "own", "heuristic"))], "family string, raw string, own_rule struct<method:string,delimiter:string,signature:string,inferred_by:string>")
    asked = []

    def denies(line):
        asked.append(line)
        raise PermissionError("denied")

    def fails(line):
        raise OSError("network")

    got = discovery.discover(firsts, {"one": denies, "two": fails})
    assert len(asked) == 1 and all(r["inferred_by"] == "heuristic" and r["llm_error"] for r in got)
    got = discovery.discover(firsts, {"one": denies, "two": lambda line: '{"method": "compositional"}'})
    assert all(r["inferred_by"] == "llm" and r["llm_error"] is None for r in got)


def test_years_of_times_without_one(spark):
    from pyspark.sql import functions as F

    from logweave.functions.timestamps import parse_ts, render

    cases = {"Dec 30 10:00:00": "2025-12-30T10:00:00Z", "Jan 4 10:00:00": "2026-01-04T10:00:00Z", "Feb 29 10:00:00": None, "count 5 items": None, "20260913": None, "10:15:32": "2026-01-01T10:15:32Z"}
    rows = spark.createDataFrame([(t,) for t in cases], "text string")
    got = rows.select("text", render(parse_ts(F.col("text"), F.lit("2026-01-05 00:00:00").cast("timestamp"))).alias("iso")).collect()
    assert {r["text"]: r["iso"] for r in got} == cases


def test_bound_values_are_no_elements_of_arrays(spark):
    """An element of a transformed array asks for its type at every row, through all that is nested in it."""
    rows = spark.createDataFrame([("2024-05-01 10:00:00 INFO a=1",)], "raw string").withColumns({"method": F.lit("compositional"), "delimiter": F.lit(None).cast("string")})
    plan = normalize(parse(rows, now()), now())._jdf.queryExecution().analyzed().toString()
    assert "aggregate(" in plan and "get(transform(" not in plan and "array_position(_" not in plan


def test_a_time_that_is_found_ends_the_search(spark):
    """first_place() asks nothing after the first hit: a later item that would raise is not met."""
    from logweave.functions.text import first_place

    got = spark.sql("select array('x', 'hit', 'raise') as a").select(first_place(F.col("a"), lambda x, _: F.when(x == "raise", F.raise_error(F.lit("asked"))).otherwise(x == "hit")).alias("at"))
    assert got.first()["at"] == 1


def test_templates_are_asked_of_deciding_records_only(spark):
    """And so the records are neither masked nor joined with the stored templates."""
    rows = spark.createDataFrame([(i, "CEF:0|Acme|IDS|1.0|100|seen|3|spt=1" if i % 2 else "plain words") for i in range(20)], "seq long, raw string")
    stored = spark.createDataFrame([("plain words", ("compositional", None, "kept", "llm"))], f"template string, rule {tiers.RULE}").select(readers.rule_key("template").alias("key"), "rule")
    template = F.when(F.col("seq") < 2, F.col("raw")).otherwise(F.raise_error(F.lit("asked for")))
    got = sorted(tiers.decide(rows, now(), templates=stored, template=template).select("seq", "tier", "template", "rule.signature").collect())
    assert got[0] == (0, "template", "plain words", "kept") and got[1][1:3] == ("discovery", rows.collect()[1]["raw"])
    assert [r["tier"] for r in got[2:]] == ["fingerprint", "family"] * 9


def test_lines_of_stored_rules_are_made_once(spark):
    assert "Generate inline" not in catalog.cascade_tiers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
