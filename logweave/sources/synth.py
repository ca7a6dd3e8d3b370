"""Deterministic log lines of 16 families made from the events table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("info", "warn", "error", "debug")
#: The lines' present: settles years of timestamps that have none.
NOW = "2024-06-01 00:00:00"

#: One template per family, as SQL over seq, ts, u, v, et, lvl, svc, host and ip.
TEMPLATES = (
    ("json", """concat('{"ts":"', iso, '","level":"', lvl, '","service":"', svc, '","msg":"', et, ' by user ', u, '","latency":', v, '}')"""),
    ("csv", "concat(day, ',', upper(lvl), ',', svc, ',', et, ' by user ', u, ',pid=', v)"),
    ("pipe", "concat(day, ' | ', upper(lvl), ' | ', svc, ' | ', et, ' by user ', u)"),
    ("rfc3164", "concat(bsd, ' ', host, ' sshd[', v, ']: Failed password for root from ', ip, ' port ', 1000 + u, ' ssh2')"),
    ("rfc5424", "concat('<', u % 192, '>1 ', iso, ' ', host, ' app', u % 3, ' ', v, ' ID', u, ' - ', et, ' happened')"),
    ("ncsa", """concat(ip, ' - user', u, ' [', web, ' +0000] "GET /p/', v, ' HTTP/1.1" ', status, ' ', v, ' "-" "agent/1.0"')"""),
    ("cef", "concat('CEF:0|Acme|IDS|1.0|', 100 + u, '|', et, ' seen|', u % 8, '|src=', ip, ' spt=', v)"),
    ("leef", "concat('LEEF:1.0|Acme|Fw|2.0|', 100 + u, '|devTime=', iso, chr(9), 'src=', ip, chr(9), 'msg=', et, ' seen')"),
    ("cri", "concat(sec, '.123456789Z stderr F ', et, ' failed for job ', u)"),
    ("nginx_error", "concat(slash, ' [error] ', v, '#0: *', u, ' open() failed, client: ', ip, ', server: s1')"),
    ("python", "concat(case when lvl = 'warn' then 'WARNING' else upper(lvl) end, ':app.views:', et, ' by user ', u)"),
    ("java", "concat(day, '.123 ', upper(lvl), ' ', v, ' --- [main] c.acme.App : ', et, ' by user ', u)"),
    ("postgres", "concat(day, ' UTC [', v, '] app@db LOG:  duration: 1.', 100 + u, ' ms')"),
    ("logfmt", """concat('ts=', iso, ' level=', lvl, ' caller=', svc, ' msg="', et, ' by user ', u, '" n=', v)"""),
    ("semicolon", "concat(day, '; ', upper(lvl), '; ', et, ' by user ', u, '; x')"),
    ("generic", "concat('[', iso, '] ', upper(lvl), ' Worker job ', u, ' took ', v, 'ms connection refused')"),
)

STAMPS = {"sec": "yyyy-MM-dd'T'HH:mm:ss", "iso": "yyyy-MM-dd'T'HH:mm:ss'Z'", "day": "yyyy-MM-dd HH:mm:ss", "slash": "yyyy/MM/dd HH:mm:ss", "bsd": "MMM dd HH:mm:ss", "web": "dd/MMM/yyyy:HH:mm:ss"}


def _users(part: str) -> list[int]:
    """The templates that use a part."""
    return [i for i, (_, template) in enumerate(TEMPLATES) if re.search(rf"\b{part}\b", template)]


def synth_lines(events: DataFrame) -> DataFrame:
    """Rows (seq, expected, raw) with the parts the templates use."""
    seq, n = F.col("event_id"), F.pmod(F.col("event_id"), F.lit(len(TEMPLATES))).cast("int")
    level = F.element_at(F.array(*map(F.lit, LEVELS)), F.pmod(F.floor(seq / len(TEMPLATES)), F.lit(4)).cast("int") + 1)
    rows = events.select(
        seq.alias("seq"),
        n.alias("n"),
        "ts",
        F.col("user_id").alias("u"),
        F.floor(F.abs("value")).cast("long").alias("v"),
        F.col("event_type").alias("et"),
        level.alias("lvl"),
        *(F.when(n.isin(*_users(name)), F.date_format("ts", layout)).alias(name) for name, layout in STAMPS.items()),
    ).selectExpr(
        "*", "concat('svc', u % 5) as svc", "concat('host-', u % 7) as host", "concat('10.0.', u % 256, '.', v % 256) as ip", "element_at(array(200, 301, 404, 500), cast(seq div 16 % 4 as int) + 1) as status"
    )
    family, raw = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, template) in enumerate(TEMPLATES):
        family = F.when(F.col("n") == i, name).otherwise(family)
        raw = F.when(F.col("n") == i, F.expr(template)).otherwise(raw)
    return rows.withColumn("expected", family).withColumn("raw", raw)


#: The same rows for DuckDB, as the body of a common table expression named lines.
LINES_SQL = (
    """
parts as (
  select event_id as seq, event_id % 16 as n, ts, user_id as u, cast(floor(abs(value)) as bigint) as v, event_type as et,
    (['info', 'warn', 'error', 'debug'])[event_id // 16 % 4 + 1] as lvl, ([200, 301, 404, 500])[event_id // 16 % 4 + 1] as status,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') as sec, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, strftime(ts, '%Y-%m-%d %H:%M:%S') as day,
    strftime(ts, '%Y/%m/%d %H:%M:%S') as slash, strftime(ts, '%b %d %H:%M:%S') as bsd, strftime(ts, '%d/%b/%Y:%H:%M:%S') as web,
    'svc' || (user_id % 5) as svc, 'host-' || (user_id % 7) as host, '10.0.' || (user_id % 256) || '.' || (cast(floor(abs(value)) as bigint) % 256) as ip
  from events
), lines as (
  select *, case n """
    + " ".join(f"when {i} then '{name}'" for i, (name, _) in enumerate(TEMPLATES))
    + " end as expected, case n "
    + " ".join(f"when {i} then {template}" for i, (_, template) in enumerate(TEMPLATES))
    + " end as raw from parts\n)"
)
