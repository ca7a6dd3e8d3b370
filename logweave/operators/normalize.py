"""Normalising parsed records into one schema."""

from __future__ import annotations

from collections.abc import Generator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import fixed
from logweave.functions.text import FLAGS, chain, let, null_if_empty, one_of, strip
from logweave.functions.timestamps import from_epoch, parse_ts, render
from logweave.operators.parse import ENTRY


def _literal_map(pairs) -> Column:
    return F.create_map(*(F.lit(x) for p in pairs for x in p))


ALIAS = [(a, name) for name, keys in fixed.ALIASES.items() for a in keys]
SEVERITY = [(w, name) for name, words in fixed.SEVERITIES.items() for w in words]


def canonical_name(key: Column) -> Column:
    """Most keys have none: a set tells it, and the map is walked for the others."""
    return let(F.lower(key), lambda k: F.when(k.isin(*(a for a, _ in ALIAS)), F.try_element_at(_literal_map(ALIAS), k)))


def canonical_severity(v: Column, kind: Column) -> Column:
    """One of six names; unknown for null, flags and nested values."""
    number = F.when(kind == "num", F.floor(v.try_cast("double")).cast("int")).otherwise(F.when(strip(v).rlike(r"^[+-]?[0-9]+$"), strip(v).try_cast("int")))
    by_number = lambda n: F.when(n.between(0, 7), F.get(F.array(*map(F.lit, fixed.SYSLOG_LEVELS)), n)).otherwise("unknown")
    word = F.btrim(F.lower(v), F.lit("[]() "))
    by_word = F.coalesce(F.try_element_at(_literal_map(SEVERITY), word), F.lit("unknown"))
    return F.when(v.isNull() | one_of(kind, ("bool", "obj")), "unknown").otherwise(let(number, lambda n: F.when(n.isNotNull(), by_number(n)).otherwise(by_word)))


def infer_event(message: Column) -> Column:
    """From the message's wording; the first that fits."""
    out = F.lit("unknown")
    for pattern, cased, name in reversed(fixed.EVENTS):
        out = F.when(message.rlike(FLAGS + ("" if cased else "(?i)") + pattern), name).otherwise(out)
    return out


def _map(entries: Column) -> Column:
    """Map of entries; of equal keys the last holds."""

    def steps():
        keys = yield F.transform(entries, lambda e: e["k"])
        back = F.reverse(keys)
        last = F.filter(entries, lambda e, i: F.array_position(back, e["k"]) == F.size(entries) - i)
        return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(last))

    return chain(steps())


def _normal(p: Column, raw: Column, now: Column) -> Generator:
    """Steps from a parsed record to the fields of the schema."""
    stamp = render(parse_ts(p["ts"], now))
    first = F.filter(F.array(F.struct(F.lit("timestamp").alias("k"), stamp.alias("v"), F.lit("str").alias("t"))).cast(ENTRY), lambda e: e["v"].isNotNull())
    every = F.filter(F.concat(first, p["fields"], p["extra"]), lambda e: (e["k"] != "raw_message") & e["v"].isNotNull() & (e["v"] != ""))
    every = yield F.transform(every, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), e["t"].alias("t"), canonical_name(e["k"]).alias("c"), i.alias("i")))
    t, s, *named = yield tuple(F.get(F.filter(every, lambda e: e["c"] == name), F.lit(0)) for name in ("timestamp", "severity", "message", "source", "event_type"))
    message, source, event = (e["v"] for e in named)
    ts, sev = yield F.when(t["t"] == "num", from_epoch(t["v"].try_cast("decimal(30,9)"))).when(t["t"] == "bool", F.lit(None)).otherwise(parse_ts(t["v"], now)), canonical_severity(s["v"], s["t"])
    odd = [
        F.when(t["v"].isNotNull() & ts.isNull(), F.struct(F.lit("timestamp_raw").alias("k"), t["v"].alias("v"))),
        F.when(s["v"].isNotNull() & (sev == "unknown"), F.struct(F.lit("severity_raw").alias("k"), s["v"].alias("v"))),
    ]
    others = F.filter(every, lambda e: e["c"].isNull() | ~one_of(e["i"], (F.coalesce(x["i"], F.lit(-1)) for x in (t, s, *named))))
    pairs = yield F.concat(F.transform(others, lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"))), F.filter(F.array(*odd), lambda e: e.isNotNull()))
    extra = yield _map(pairs)
    code = F.try_element_at(extra, F.lit("http_status"))
    web = F.coalesce(F.try_element_at(extra, F.lit("http_method")), code).isNotNull()
    kind = yield F.coalesce(event, F.when(web, "http_request").otherwise(infer_event(F.coalesce(null_if_empty(message), raw))))
    number = code.try_cast("int")
    filled = (
        F.when(sev != "unknown", sev)
        .when(code.isNotNull(), F.when(number >= 500, "error").when(number >= 400, "warning").when(number >= 100, "info").otherwise("unknown"))
        .when(kind == "auth_failure", "warning")
        .when(one_of(kind, ("connection_error", "exception")), "error")
        .otherwise("unknown")
    )
    other = F.coalesce(*(null_if_empty(F.try_element_at(extra, F.lit(k))) for k in fixed.SOURCE_FALLBACKS), F.lit("unknown"))
    made = {"ts": ts, "extra": extra, "source": F.coalesce(source, other), "message": F.coalesce(message, strip(raw)), "event_type": kind, "severity": filled, "timestamp": render(ts)}
    return F.struct(*(c.alias(k) for k, c in made.items()))


def normalize(df: DataFrame, now: Column, raw: str = "raw") -> DataFrame:
    """Adds timestamp, ts, source, event_type, severity, message and extra to rows with parsed; drops parsed.

    Entries are read in order, parsed before extra ones; the first key of a canonical name gives its value, other
    keys go to extra. What can't be read as time or severity is kept there under its own name.
    """
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != "parsed"), F.inline(F.array(chain(_normal(F.col("parsed"), F.col(raw), now)))))
