"""Format parsers: each record becomes a time text and ordered entries of parsed and extra fields."""

from __future__ import annotations

from collections.abc import Generator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import fixed
from logweave.functions.text import SEVERITY_PREFIX, after, chain, clean, extract, first_place, groups, is_json_object, let, matches, null_if_empty, occurrences, one_of, settled, strip
from logweave.functions.timestamps import parse_ts, render

ENTRY = "array<struct<k:string,v:string,t:string>>"
RESULT = f"struct<ts:string,fields:{ENTRY},extra:{ENTRY}>"
_L = fixed.LAYOUTS
_LEVEL = ("CRITICAL", "CRITICAL", "CRITICAL", "ERROR", "WARNING", "INFO", "INFO", "DEBUG")


def _entries(pairs) -> Column:
    """Entries of (key, value[, type]) whose values are neither null nor empty."""
    if not pairs:
        return F.array().cast(ENTRY)
    made = F.array(*(F.struct(F.lit(p[0]).alias("k"), p[1].cast("string").alias("v"), F.lit(p[2] if len(p) > 2 else "str").alias("t")) for p in pairs))
    return F.filter(made, lambda e: e["v"].isNotNull() & (e["v"] != ""))


def _zipped(keys: Column, values: Column) -> Column:
    return F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v"), F.lit("str").alias("t")))


def _result(ts: Column | None, fields, extra, more: Column | None = None) -> Column:
    made = _entries(extra)
    return F.struct((F.lit(None).cast("string") if ts is None else null_if_empty(ts)).alias("ts"), _entries(fields).alias("fields"), (made if more is None else F.concat(made, more)).alias("extra"))


def _level(pri: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _LEVEL)), F.pmod(pri, F.lit(8)) + 1)


def _dash(c: Column) -> Column:
    return F.when(c != "-", c)


def ncsa(g: Column) -> Column:
    status, words = g[5].try_cast("int"), F.split(strip(g[4]), r"\s+")
    enough = F.size(words) >= 2
    size = _dash(g[6])
    return _result(
        g[3],
        [("source", g[0]), ("message", g[4]), ("event_type", F.lit("http_request")), ("severity", F.when(status >= 500, "ERROR").when(status >= 400, "WARNING").otherwise("INFO"))],
        [
            ("http_status", status, "num"), ("user", _dash(g[2])), ("bytes_sent", F.when(size.rlike("^[0-9]+$"), F.coalesce(size.try_cast("decimal(38,0)").cast("string"), size)).otherwise(size), "num"),
            ("referer", _dash(g[7])), ("user_agent", _dash(g[8])), ("http_method", F.when(enough, F.get(words, F.lit(0)))), ("http_path", F.when(enough, F.get(words, F.lit(1)))),
            ("http_proto", F.get(words, F.lit(2))),
        ],
    )


def _extension(ext: Column, pattern: str) -> Column:
    """Pairs of an extension; an escaped equals sign is part of a value."""
    bare = F.replace(ext, F.lit("\\="), F.lit("\x02"))
    part = [F.regexp_extract_all(bare, F.lit(f"(?d){pattern}"), F.lit(i)) for i in (1, 2)]
    return _zipped(part[0], F.transform(part[1], lambda v: F.replace(strip(v), F.lit("\x02"), F.lit("="))))


def cef(g: Column) -> Column:
    maker = strip(F.concat(g[1], F.lit(" "), g[2]))
    return _result(
        None,
        [("source", F.coalesce(null_if_empty(maker), F.lit("unknown"))), ("message", g[5]), ("event_type", F.coalesce(null_if_empty(g[4]), F.lit("security_event"))), ("severity", g[6])],
        [("cef_version", g[0]), ("device_vendor", g[1]), ("device_product", g[2]), ("device_version", g[3]), ("event_class_id", g[4])],
        _extension(g[7], fixed.EXTENSION_PAIR),
    )


def leef(g: Column) -> Column:
    maker = strip(F.concat(g[1], F.lit(" "), g[2]))
    tabbed = fixed.EXTENSION_PAIR.replace(r"\s+", r"\t")
    return _result(
        None,
        [("source", F.coalesce(null_if_empty(maker), F.lit("unknown"))), ("event_type", F.coalesce(null_if_empty(g[4]), F.lit("security_event")))],
        [("leef_version", g[0]), ("device_vendor", g[1]), ("device_product", g[2])],
        F.when(g[5].contains("\t"), _extension(g[5], tabbed)).otherwise(_extension(g[5], fixed.EXTENSION_PAIR)),
    )


def rfc5424(g: Column) -> Column:
    pri = g[0].try_cast("int")
    data = extract(g[7], r"^(\[[^\]]+\])\s*(.*)$", 1)
    rest = F.when(data != "", extract(g[7], r"^(\[[^\]]+\])\s*(.*)$", 2)).otherwise(g[7])
    return _result(
        g[2],
        [("severity", _level(pri)), ("source", _dash(g[3])), ("event_type", _dash(g[6])), ("message", strip(F.ltrim(rest, F.lit("- "))))],
        [("facility", F.shiftright(pri, 3), "num"), ("syslog_version", g[1].try_cast("int"), "num"), ("program", _dash(g[4])), ("pid", _dash(g[5])), ("structured_data", data)],
    )


def nginx(g: Column) -> Column:
    tail = extract(g[4], r",\s*(client:\s*[^,]+.*)$")
    pairs = F.filter(F.split(tail, r",\s*"), lambda p: p.contains(":"))
    return _result(
        g[0],
        [("severity", F.upper(g[1])), ("source", F.lit("nginx")), ("event_type", F.lit("web_error")), ("message", F.when(tail != "", strip(F.regexp_replace(g[4], r"(?d),\s*client:\s*[^,]+.*$", ""))).otherwise(g[4]))],
        [("pid", g[2]), ("connection_id", g[3])],
        _zipped(F.transform(pairs, lambda p: strip(F.substring_index(p, ":", 1))), F.transform(pairs, lambda p: F.btrim(strip(F.substring(p, F.instr(p, ":") + 1, F.length(p))), F.lit('"')))),
    )


def spring(g: Column) -> Column:
    return _result(g[0], [("severity", g[1]), ("source", g[4]), ("message", strip(g[5]))], [("pid", g[2]), ("thread", strip(g[3]))])


def java(g: Column) -> Column:
    logger = F.coalesce(null_if_empty(g[3]), null_if_empty(g[4]), null_if_empty(g[5]))
    thread = F.coalesce(null_if_empty(g[1]), null_if_empty(g[6]), null_if_empty(g[7]))
    return _result(g[0], [("severity", g[2]), ("message", strip(g[8])), ("source", F.when(F.length(logger) > 2, logger))], [("thread", thread)])


def postgres(g: Column) -> Column:
    return _result(g[0], [("severity", g[3]), ("source", F.lit("postgres")), ("message", strip(g[4]))], [("pid", g[1]), ("user_database", g[2])])


def _logfmt(c: Column, now: Column) -> Column:
    """Null unless at least three pairs cover 45 % of a line without brackets."""
    # Keys of logfmt fields.
    kinds = (("ts", "time", "timestamp", "datetime", "date"), ("level", "lvl", "severity"), ("msg", "message"), ("caller", "service", "host", "logger", "app"))

    def steps():
        part = [F.regexp_extract_all(c, F.lit(fixed.LOGFMT_PAIR), F.lit(i)) for i in (1, 2, 3, 4)]
        values = F.transform(F.arrays_zip(*(p.alias(f"g{i}") for i, p in enumerate(part[1:]))), lambda e: F.coalesce(null_if_empty(e["g0"]), null_if_empty(e["g1"]), e["g2"]))
        pairs = yield _zipped(part[0], values)
        covered = F.aggregate(pairs, F.lit(0), lambda n, e: n + F.length(e["k"]) + 1 + F.length(e["v"]))
        return F.when((F.size(pairs) >= 3) & (covered >= F.length(c) * 0.45), chain(read(pairs)))

    def read(pairs):
        named = lambda keys: first_place(pairs, lambda e, _: one_of(F.lower(e["k"]), keys))
        at = yield first_place(pairs, lambda e, _: one_of(F.lower(e["k"]), kinds[0]) & parse_ts(e["v"], now).isNotNull()), *map(named, kinds[1:])
        value = lambda i: F.when(at[i] >= 0, F.get(pairs, at[i])["v"])
        rest = F.filter(pairs, lambda e, i: ~F.array_contains(F.array(*at), i))
        return _result(value(0), [("severity", F.upper(value(1))), ("message", value(2)), ("source", value(3))], [], rest)

    return F.when((occurrences(c, "=") >= 3) & ~c.rlike(r"[\[(]"), chain(steps()))


def _first_time(found: list[Column], now: Column) -> Column:
    """The first of candidates (x, bsd) that can be read, with its ts; those after it are not tried."""
    none = F.lit(None).cast("struct<x:string,bsd:boolean,ts:timestamp>")
    tried = lambda c: let(parse_ts(F.btrim(c["x"], F.lit("[]")), now), lambda ts: F.when(ts.isNotNull(), F.struct(c["x"].alias("x"), c["bsd"].alias("bsd"), ts.alias("ts"))))
    return F.aggregate(F.array(*found), none, lambda got, c: F.when(got.isNotNull(), got).when(c["x"] != "", tried(c)))


def _generic(line: Column, now: Column) -> Generator:
    """Steps to the zones taken one after the other from the start of the line."""
    pri = yield extract(line, r"^<(\d{1,3})>")
    r0 = yield F.when(pri != "", after(line, F.concat(F.lit("<"), pri, F.lit(">")))).otherwise(line)
    fixed_times = [F.struct(extract(r0, p, 0).alias("x"), F.lit(i == 3).alias("bsd")) for i, p in enumerate(fixed.OPENING_TIMES)]

    def hinted():
        words = yield F.split(r0, r"\s+")
        opening = [F.array_join(F.slice(words, 1, i), " ") for i in (1, 2, 3)]
        fits = lambda i, o: F.btrim(o, F.lit("[]")).rlike(fixed.DATE_HINT) & (F.size(words) >= i)
        return _first_time([F.struct(F.when(fits(i, o), o).otherwise("").alias("x"), matches(F.btrim(o, F.lit("[]")), r"^[A-Z][a-z]{2}\s+\d{1,2}").alias("bsd")) for i, o in zip((1, 2, 3), opening)], now)

    time = yield F.coalesce(_first_time(fixed_times, now), chain(hinted()))
    r1 = yield F.when(time.isNotNull(), after(r0, time["x"])).otherwise(r0)
    sev0 = F.when(pri != "", _level(pri.try_cast("int")))
    hit = yield F.when(sev0.isNull(), extract(r1, SEVERITY_PREFIX, 0)).otherwise("")
    sev1, r2 = yield F.coalesce(sev0, null_if_empty(F.upper(extract(hit, SEVERITY_PREFIX)))), F.when(hit != "", after(r1, hit)).otherwise(r1)
    head = yield F.when(F.coalesce(time["bsd"], F.lit(False)), groups(r2, _L["syslog_head"], 3))
    r3 = yield F.when(head.isNotNull(), F.regexp_replace(r2, "(?d)" + _L["syslog_head"], "")).otherwise(r2)
    context = yield extract(r3, r"^(?:\[[^\]]+\]|\([^)]+\))", 0)
    r4 = yield F.when(context != "", after(r3, context)).otherwise(r3)
    hit2 = yield F.when((context != "") & sev1.isNull(), extract(r4, SEVERITY_PREFIX, 0)).otherwise("")
    sev2, r5 = yield F.coalesce(sev1, null_if_empty(F.upper(extract(hit2, SEVERITY_PREFIX)))), F.when(hit2 != "", after(r4, hit2)).otherwise(r4)
    tail, ip, user = yield F.when(r5.contains("}"), extract(r5, r"(\{.*\})\s*$")).otherwise(""), null_if_empty(extract(line, fixed.IPV4, 0)), null_if_empty(extract(line, fixed.USER))
    payload = yield F.when((tail != "") & ~matches(r5, r"^[^{]*\[.*\]\s*$") & is_json_object(tail), tail)
    message = strip(F.when(payload.isNotNull(), F.rtrim(F.regexp_replace(r5, r"(?d)\{.*\}\s*$", ""), F.lit(" -:,|"))).otherwise(r5))
    spot = F.substring(line, F.instr(line, F.concat(ip, F.lit(":"))) + F.length(ip) + 1, F.lit(6))
    port = F.coalesce(null_if_empty(extract(line, fixed.PORT)), F.when(line.contains(F.concat(ip, F.lit(":"))), null_if_empty(extract(spot, r"^(\d{2,5})\b"))))
    ctx = F.regexp_replace(context, r"^[\[(]|[\])]$", "")
    named = [
        ("facility", F.shiftright(pri.try_cast("int"), 3), "num"), ("program", head[1]), ("pid", head[2]), ("context", ctx), ("json_payload", payload, "obj"),
        ("ip", ip), ("port", port), ("user", F.when(~one_of(F.lower(user), fixed.NOT_USERS), user)),
    ]
    own = yield _result(render(time["ts"]), [("severity", sev2), ("source", F.coalesce(head[0], ip)), ("message", message)], named)

    def pairs():
        """Of pairs in the text, the first of a key counts, and none replaces what a zone gave."""
        free = yield _zipped(F.regexp_extract_all(line, F.lit(fixed.FREE_PAIR), F.lit(1)), F.transform(F.regexp_extract_all(line, F.lit(fixed.FREE_PAIR), F.lit(2)), lambda v: F.regexp_replace(v, r"""^"([\s\S]*)"$|^'([\s\S]*)'$""", "$1$2")))
        seen, keys = yield F.transform(own["extra"], lambda e: e["k"]), F.transform(free, lambda e: e["k"])
        return F.filter(free, lambda e, i: ~F.array_contains(seen, e["k"]) & (F.array_position(keys, e["k"]) == i + 1))

    fresh = F.when(line.contains("="), chain(pairs())).otherwise(F.array().cast(ENTRY))
    return F.struct(own["ts"].alias("ts"), own["fields"].alias("fields"), F.concat(own["extra"], fresh).alias("extra"))


def _opens(c: Column, low: str, high: str) -> Column:
    """Whether the first letter lies in a range: told without a regular expression, which only fitting lines meet."""
    return (c >= low) & (c < chr(ord(high) + 1))


def _python_log(s: Column) -> Column:
    """Three layouts; the first only for known severity words."""
    colon = F.when(_opens(s, "A", "Z"), let(groups(s, _L["python_colon"], 3), lambda g: F.when(F.get(g, F.lit(0)).isin(*fixed.SEVERITY_WORDS), _result(None, [("severity", g[0]), ("source", g[1]), ("message", strip(g[2]))], []))))
    dash = _laid(s, "python_dash", 4, lambda g: _result(g[0], [("severity", g[2]), ("source", g[1]), ("message", strip(g[3]))], []))
    caller = _laid(s, "python_caller", 4, lambda g: _result(g[0], [("severity", g[2]), ("source", g[1]), ("message", strip(g[3]))], [("caller", g[1])]))
    return F.coalesce(colon, dash, caller)


def _laid(s: Column, layout: str, n: int, make) -> Column:
    """The layout's result where it fits; a condition that its lines meet comes first."""
    begins = {"cef": s.startswith("CEF:"), "leef": s.startswith("LEEF:"), "rfc5424": s.startswith("<"), "python_caller": s.startswith("["), "ncsa": s.contains('"')}
    return F.when(begins.get(layout, _opens(s, "0", "9")), let(groups(s, _L[layout], n), lambda g: F.when(g.isNotNull(), make(g))))


def with_compositional(df: DataFrame, s: str, out: str, now: Column) -> DataFrame:
    """Adds the result of the first layout that fits, else of the generic zones; those see only what is left."""
    c = F.col(s)
    layouts = (("ncsa", 9, ncsa), ("cef", 8, cef), ("leef", 6, leef), ("rfc5424", 8, rfc5424), ("nginx_error", 5, nginx), ("spring", 6, spring), ("java", 9, java))
    tries = [_laid(c, *x) for x in layouts] + [_python_log(c), _laid(c, "postgres", 5, postgres)]
    df = settled(df.withColumn("_fit", F.coalesce(*tries)))
    df = settled(df.withColumn("_pairs", F.when(F.col("_fit").isNull(), _logfmt(c, now))))
    zones = F.when(c.isNotNull() & F.col("_fit").isNull() & F.col("_pairs").isNull(), chain(_generic(c, now)))
    return settled(df.withColumn(out, F.coalesce("_fit", "_pairs", zones)).drop("_fit", "_pairs"))


def json_entries(s: Column) -> Column:
    """Entries of a JSON object in document order, with the kind of each value; null for anything else."""
    kind = lambda t: F.when(t == "STRING", "str").when(t == "BOOLEAN", "bool").when(t.rlike("^(BIGINT|DECIMAL|DOUBLE)"), "num").otherwise("obj")
    read = F.map_entries(F.from_json(s, "map<string,variant>", {"allowSingleQuotes": "false"}))
    typed = F.transform(read, lambda e: F.struct(e["key"].alias("k"), e["value"].alias("x"), F.schema_of_variant(e["value"]).alias("s")))
    made = F.transform(typed, lambda e: F.struct(e["k"].alias("k"), F.when(e["s"] == "VOID", F.lit(None)).when(e["s"] == "STRING", F.try_variant_get(e["x"], "$", "string")).otherwise(F.to_json(e["x"])).alias("v"), kind(e["s"]).alias("t")))
    return F.when(is_json_object(s), made.cast(ENTRY))


def _renamed(entries: Column) -> Column:
    """Short keys of database logs: t.$date, s and c, where the long key is missing."""
    has = lambda k: F.exists(entries, lambda e: e["k"] == k)
    stamp = lambda e: F.get_json_object(e["v"], "$['$date']")
    return F.transform(
        entries,
        lambda e: F.when((e["k"] == "t") & (e["t"] == "obj") & stamp(e).isNotNull(), F.struct(F.lit("timestamp").alias("k"), stamp(e).alias("v"), F.lit("str").alias("t")))
        .when((e["k"] == "s") & ~has("severity"), F.struct(F.lit("severity").alias("k"), e["v"].alias("v"), e["t"].alias("t")))
        .when((e["k"] == "c") & ~has("source"), F.struct(F.lit("source").alias("k"), e["v"].alias("v"), e["t"].alias("t")))
        .otherwise(e),
    ).cast(ENTRY)


def _delimited(line: Column, delimiter: Column, now: Column) -> Generator:
    """Steps to the fields of a delimited line; quotes hold a delimiter. Of what is neither time, severity nor pair, the longest is the message and the first other single word the source."""
    one = F.split(line, "\n")[0]
    cut = lambda c: F.regexp_extract_all(one, F.lit(rf'(?:^|{c})([^{c}"]*+(?:"[^"]*+"[^{c}"]*+)*+)'), F.lit(1))
    parts = F.when(delimiter == "|", cut(r"\|")).when(delimiter == ",", cut(",")).when(delimiter == ";", cut(";")).otherwise(cut("\t"))
    bare = lambda p: strip(F.replace(F.regexp_replace(p, r'^\s*"([\s\S]*)"\s*$', "$1"), F.lit('""'), F.lit('"')))
    every = yield F.filter(F.transform(parts, bare), lambda p: p != "")
    stamp = yield first_place(every, lambda p, _: parse_ts(p, now).isNotNull())
    level = yield first_place(every, lambda p, i: (F.length(p) <= 12) & (i != stamp) & matches(p, SEVERITY_PREFIX))
    paired = lambda p: p.contains("=") & ~F.substring_index(p, "=", 1).contains(" ")
    left = yield F.filter(every, lambda p, i: (i != stamp) & (i != level))
    pairs = F.transform(F.filter(left, paired), lambda p: F.struct(strip(F.substring_index(p, "=", 1)).alias("k"), strip(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v"), F.lit("str").alias("t")))
    texts = yield F.filter(left, lambda p: ~paired(p))
    sizes = yield F.transform(texts, lambda p: F.regexp_count(p, F.lit(r"\S+")))
    most = yield F.array_max(sizes)
    longest = yield first_place(sizes, lambda n, _: n == most)
    single = yield first_place(sizes, lambda n, i: (n == 1) & (i != longest))
    named = lambda of: F.transform(of, lambda p, i: F.struct(F.concat(F.lit("field_"), i).alias("k"), p.alias("v"), F.lit("str").alias("t")))
    at = lambda a, i: F.when(i >= 0, F.get(a, i))
    fields = _entries([("severity", F.upper(F.btrim(at(every, level), F.lit("[]")))), ("message", at(texts, longest)), ("source", at(texts, single))])
    others = F.filter(named(texts), lambda e, i: (i != longest) & (i != single))
    known = (stamp >= 0) | (level >= 0)
    return F.struct(at(every, stamp).alias("ts"), F.when(known, fields).otherwise(named(every)).alias("fields"), F.when(known, F.concat(pairs, others)).otherwise(F.array().cast(ENTRY)).alias("extra"))


def parse(df: DataFrame, now: Column, raw: str = "raw", method: str = "method", delimiter: str = "delimiter") -> DataFrame:
    """Adds parsed (ts, fields, extra) by each record's rule.

    Container wrappers are opened one level deep: the inner line of a docker object or a CRI line goes through the
    layouts, and the wrapper's own fields are merged around the result.
    """
    df = df.withColumn("_s", clean(F.col(raw)))
    df = df.withColumn("_j", F.when(F.col(method) == "json", json_entries(F.col("_s"))))
    value = lambda k: F.get(F.filter("_j", lambda e: e["k"] == k), F.lit(0))
    docker = F.coalesce((value("log")["t"] == "str") & F.exists("_j", lambda e: e["k"].isin("stream", "time")), F.lit(False))
    df = df.withColumn("_docker", docker).withColumn("_cri", F.when(F.col("_j").isNull(), groups(F.col("_s"), _L["cri"], 4)))
    df = df.withColumn("_line", F.when(F.col("_docker"), clean(value("log")["v"])).when(F.col("_cri").isNotNull(), strip(F.col("_cri")[3])).otherwise(F.col("_s")))
    df = df.withColumn("_inner", F.when(F.col("_cri").isNotNull(), json_entries(F.col("_line"))))
    free = F.col("_docker") | (F.col("_cri").isNotNull() & F.col("_inner").isNull()) | (F.col("_j").isNull() & F.col("_cri").isNull() & (F.col(method) != "delimiter"))
    df = with_compositional(settled(df.withColumn("_line", F.when(free, F.col("_line")))), "_line", "_comp", now)
    comp, level = F.col("_comp"), F.when(F.col("_cri")[1] == "stderr", "ERROR").otherwise("INFO")
    own = [("stream", F.col("_cri")[1]), ("cri_flag", F.col("_cri")[2]), ("severity", level)]
    mine = _entries([("severity", level)])
    inner = F.coalesce("_inner", comp["fields"])
    without = lambda a, b: F.filter(a, lambda e: ~F.exists(b, lambda x: x["k"] == e["k"]))
    fields = F.concat(without(mine, inner), inner, without(_entries([("message", F.col("_line"))]), inner))
    extra = F.when(F.col("_inner").isNotNull(), _entries(own)).otherwise(F.concat(without(_entries(own), comp["extra"]), comp["extra"]))
    cri = F.struct(F.coalesce(F.when(F.col("_inner").isNotNull(), F.get(F.filter("_inner", lambda e: e["k"] == "timestamp"), F.lit(0))["v"]), F.col("_cri")[0]).alias("ts"), fields.alias("fields"), extra.alias("extra")).cast(RESULT)
    outer = F.filter("_j", lambda e: e["k"] != "log")
    wrapped = F.struct(comp["ts"].alias("ts"), comp["fields"].alias("fields"), F.concat(without(comp["extra"], outer), outer).alias("extra")).cast(RESULT)
    plain = F.struct(F.lit(None).cast("string").alias("ts"), _renamed(F.col("_j")).alias("fields"), F.array().cast(ENTRY).alias("extra")).cast(RESULT)
    result = (
        F.when(F.col("_docker"), wrapped)
        .when(F.col("_j").isNotNull(), plain)
        .when(F.col(method) == "delimiter", chain(_delimited(F.col("_s"), F.col(delimiter), now)))
        .when(~F.col(method).isin("json", "compositional"), F.struct(F.lit(None).cast("string").alias("ts"), _entries([("raw_message", F.col("_s"))]).alias("fields"), F.array().cast(ENTRY).alias("extra")).cast(RESULT))
        .when(F.col("_cri").isNotNull(), cri)
        .otherwise(comp)
    )
    return df.withColumn("parsed", result).drop("_s", "_j", "_docker", "_cri", "_line", "_inner", "_comp")
