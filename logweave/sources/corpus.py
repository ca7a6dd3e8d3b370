"""A labelled corpus of log lines: 12 formats a gate is trained on and 4 it has never seen.

A label has one shape or several, of which a line takes one. A shape is text with tokens: <a..b> a number, <a..b:0w> padded with zeros to w digits (or :w with spaces), <x|y|z> one of
several, <host> a host name. What stands for a token is picked by a hash of seed, shape, line number and place, so
lines depend on nothing else; the same shapes give a Spark and a DuckDB expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.text import settled

HOSTS, OTHER_HOSTS = ("tarn", "ridge-2", "moor-3", "fen-11", "scree"), ("delta-4", "lagoon", "reef-6", "atoll-7", "sound")
_DAY = "20<19..24>-<1..12:02>-<1..28:02>"
_CLOCK = "<0..23:02>:<0..59:02>:<0..59:02>"
_BSD = f"<Jan|Apr|Jun|Aug|Nov> <1..28:2> {_CLOCK} <host> "
_V5 = f"<<8..190>>1 {_DAY}T{_CLOCK}.<0..999999:06>Z <host> "
_JAVA = f"{_DAY} {_CLOCK},<100..999>  "
_CRI = f"{_DAY}T{_CLOCK}.<0..999999:06>Z "
_PG = f"{_DAY} {_CLOCK} UTC [<300..32000>] "
_WEB = "203.0.113.<1..254> - <kim|ada|noor|-> [<1..28:02>/Oct/2023:" + _CLOCK + " +0000] "

#: Shapes of each known format, made up from the formats' public descriptions; a line takes one of them.
KNOWN = {
    "syslog_bsd": (
        _BSD + "dhcpd[<300..4000>]: lease of pool <1..40> renewed for <1..900> minutes",
        _BSD + "crond[<300..60000>]: job <rotate|reindex|prune> took <1..600> seconds",
        _BSD + "smartd[<2..99>]: disk <0..11> reached <30..70> degrees",
        _BSD + "named[<300..9000>]: zone <0..60>.example.net loaded with serial <1000..9999>",
    ),
    "syslog_rfc5424": (
        _V5 + "chronyd <200..30000> EV<10..14> - offset is <1..900> microseconds",
        _V5 + "mdadm <200..30000> EV<15..19> - array <0..7> rebuilt to <1..100> percent",
        _V5 + "lldpd <200..30000> EV<20..24> - neighbour seen on port <1..48>",
    ),
    "json_structured": (
        f'{{"@timestamp":"{_DAY}T{_CLOCK}Z","severity":"<info|warning|error|debug>","component":"<ledger|depot|courier>","message":"parcel <1..9000> <weighed|scanned|returned>","elapsed":<1..900>}}',
        f'{{"@timestamp":"{_DAY}T{_CLOCK}Z","severity":"<info|warning|error|debug>","component":"<kiln|loom>","message":"shift <1..3> <opened|handed over>","workers":<1..60>}}',
    ),
    "spring_boot": (
        _JAVA + "<INFO|WARN|ERROR> <100..9999> --- [worker-<1..16>] n.quay.stock.Ledger  : Ledger closed with <1..500> entries",
        _JAVA + "<INFO|WARN|ERROR> <100..9999> --- [timer-<1..4>] n.quay.crane.Hoist  : Hoist <1..30> waits for <1..90> minutes",
    ),
    "python_logging": (
        "<INFO|WARNING|ERROR|CRITICAL>:etl.load:batch <1..90> holds <1..5000> rows",
        "<DEBUG|INFO|WARNING>:etl.clean:column price has <1..40> gaps",
        "<INFO|ERROR>:sched:next run in <1..60> minutes",
    ),
    "k8s_cri": (
        _CRI + "<stdout|stderr> <F|P> volume data-<0..9> mounted after <1..80> ms",
        _CRI + "<stdout|stderr> F queue length is <0..500>",
        _CRI + "stdout <F|P> leader is replica <0..4> in term <1..70>",
    ),
    "nginx_err": (
        f"20<19..24>/<1..12:02>/<1..28:02> {_CLOCK} [error] <20..900>#<0..31>: *<1..90000> no live upstreams in pool <1..12>, client: 198.51.100.<1..254>, server: shop.example",
        f"20<19..24>/<1..12:02>/<1..28:02> {_CLOCK} [error] <20..900>#<0..31>: *<1..90000> rewrite cycle at depth <10..20>, client: 198.51.100.<1..254>, server: wiki.example",
    ),
    "cef": (
        "CEF:0|Lumen|Gate|3.<0..4>|<10..99>|Session torn down|<0..10>|src=203.0.113.<1..254> act=<drop|pass> cnt=<1..50>",
        "CEF:0|Harbor|Scanner|7.<0..9>|<200..260>|File put aside|<0..10>|fname=part<1..400>.bin fsize=<1..90000> act=hold",
    ),
    "logfmt": (
        f'time={_DAY}T{_CLOCK}Z level=<info|warn|error> component=<raft|gossip> msg="snapshot <sent|taken>" index=<1..9000> took=<1..700>ms',
        f'time={_DAY}T{_CLOCK}Z level=<debug|info> component=store msg="segment merged" level_no=<0..6> bytes=<100..90000>',
    ),
    "postgres": (
        _PG + "<mira|otto>@<atlas|census> <LOG|WARNING>:  checkpoint wrote <1..9000> buffers",
        _PG + "<mira|otto>@atlas <LOG|ERROR>:  temporary file of <1..5000> kB",
        _PG + "otto@census ERROR:  statement: VACUUM part_<1..30> canceled",
    ),
    "ncsa_combined": (
        _WEB + '"<GET|HEAD> /maps/<1..18>/<0..99>.png HTTP/1.1" <200|304|404> <100..40000> "https://atlas.example" "Wget/1.21"',
        _WEB + '"<POST|DELETE> /v<1..3>/notes/<1..900> HTTP/1.1" <201|403|500> <20..900> "-" "okhttp/4.9"',
    ),
    "app_generic_kv": (
        f"[{_DAY}T{_CLOCK}Z] <INFO|WARN|ERROR> Meter <1..400> reads <0..900> outside of band <1..9>",
        f"[{_DAY}T{_CLOCK}Z] <INFO|WARN> Valve <1..60> turned by <1..90> degrees",
    ),
}
#: Shapes of each format never seen in training.
UNKNOWN = {
    "aws_cloudtrail": ('{"eventVersion":"1.08","eventSource":"<iam|kms|ec2>.example.org","eventName":"<ListRoles|CreateKey|StopFleet>","awsRegion":"<north|south>-<1..3>","userIdentity":{"principalId":"P<100..999>"},"readOnly":"<true|false>"}',),
    "windows_evtxml": ("<lt>Event><lt>System><lt>Provider Name='Service Control Manager'/><lt>EventID>70<30..45><lt>/EventID><lt>Computer><host><lt>/Computer><lt>/System><lt>EventData><lt>Data Name='param1'>Spooler <1..9><lt>/Data><lt>/EventData><lt>/Event>",),
    "juniper_netconf": (f"<Jan|Apr|Jun|Aug|Nov> <1..28:2> {_CLOCK} <mx1|ex3> mgd[<300..9000>]: UI_COMMIT_PROGRESS: step <1..40> of <41..60>", f"<Jan|Apr|Jun|Aug|Nov> <1..28:2> {_CLOCK} <mx1|ex3> rpd[<300..9000>]: BGP_PEER_STATE: peer <1..90> left Established"),
    "oracle_audit": ('LENGTH : <100..400> ACTION :[<1..9>] <lt>CONNECT> DATABASE USER:[<3..8>] <lt>scott> STATUS:[1] <lt><0..9>> DBID:[10] <lt><1000..9999>>',),
}
_TOKEN = re.compile(r"<(?:(lt)|(host)|(\d+)\.\.(\d+)(?::(0?)(\d+))?|([^<>]*\|[^<>]*))>")
_HEX = {"spark": "cast(conv(substr(md5({0}), 1, 7), 16, 10) as bigint)", "duckdb": "cast('0x' || substr(md5({0}), 1, 7) as bigint)"}


def number(dialect: str, key: str, below: int) -> str:
    """A number from 0 on, picked by a key expression of text."""
    return f"({_HEX[dialect].format(key)} % {below})"


def _quote(dialect: str, s: str) -> str:
    return "'" + (s.replace("\\", "\\\\").replace("'", "\\'") if dialect == "spark" else s.replace("'", "''")) + "'"


def _part(options: list[str], low: int = 0, span: int = 0, width: int = 0, fill: str = "0", host: bool = False) -> str:
    """A part of a shape as a struct: one of options, a number from low on, or a host."""
    return f"{{'options': [{', '.join(_quote('duckdb', o) for o in options)}], 'low': {low}, 'span': {span}, 'width': {width}, 'fill': '{fill}', 'host': {str(host).lower()}}}"


def _parts(shape: str) -> str:
    """SQL text, for DuckDB, of a shape's parts in order."""
    out, at = [], 0
    for m in _TOKEN.finditer(shape):
        if m.start() > at:
            out.append(_part([shape[at : m.start()]]))
        at = m.end()
        lt, host, low, high, zero, width, options = m.groups()
        if lt:
            out.append(_part(["<"]))
        elif host:
            out.append(_part([""], host=True))
        elif options:
            out.append(_part(options.split("|")))
        else:
            out.append(_part([""], int(low), int(high) - int(low) + 1, int(width or 0), zero or " "))
    if at < len(shape):
        out.append(_part([shape[at:]]))
    return f"[{', '.join(out)}]"


def _tokens(shape: str) -> str:
    """SQL text, for Spark, of a shape's tokens with their places among its parts and the text before each; what stands after the last has no options."""
    out, at, place, before = [], 0, 0, ""
    for m in _TOKEN.finditer(shape):
        if m.start() > at:
            before, place = before + shape[at : m.start()], place + 1
        at = m.end()
        lt, host, low, high, zero, width, options = m.groups()
        if lt:
            before, place = before + "<", place + 1
            continue
        listed = ", ".join(_quote("spark", o) for o in (options.split("|") if options else [""]))
        numbers = f"{int(low)}, 'span', {int(high) - int(low) + 1}, 'width', {int(width or 0)}" if low else "0, 'span', 0, 'width', 0"
        out.append(f"named_struct('before', {_quote('spark', before)}, 'place', '{place}', 'options', array({listed}), 'n', {len(options.split('|')) if options else 0}, 'low', {numbers}, 'fill', '{zero or ' '}', 'host', {str(bool(host)).lower()})")
        before, place = "", place + 1
    if before or at < len(shape):
        out.append(f"named_struct('before', {_quote('spark', before + shape[at:])}, 'place', '', 'options', array(''), 'n', 0, 'low', 0, 'span', 0, 'width', 0, 'fill', ' ', 'host', false)")
    return f"array({', '.join(out)})"


def labels_sql(dialect: str, labels: list[str], line: str) -> str:
    n = f"cast({line} % {len(labels)} + 1 as int)"
    listed = ", ".join(f"'{x}'" for x in labels)
    return f"element_at(array({listed}), {n})" if dialect == "spark" else f"list_extract([{listed}], {n})"


def lines_sql(dialect: str, shapes: dict[str, tuple[str, ...]], line: str = "seq", fresh: str = "fresh", seed: int = 11) -> str:
    """SQL text of a line of a label: line is the number's column, fresh a condition under which hosts are other ones.

    All shapes are one constant map, so the expression has the same size however many there are.
    """
    spark = dialect == "spark"
    table = {f"{k}.{i}": _tokens(x) if spark else _parts(x) for k, v in shapes.items() for i, x in enumerate(v)}
    sizes = {k: str(len(v)) for k, v in shapes.items()}
    map_of = lambda m: f"map({', '.join(f'{_quote(dialect, k)}, {v}' for k, v in m.items())})" if spark else f"MAP {{{', '.join(f'{_quote(dialect, k)}: {v}' for k, v in m.items())}}}"
    at = lambda m, k: f"element_at({m}, {k})" if spark else f"{m}[{k}]"
    pick = lambda key: _HEX[dialect].format(key)
    nth = f"({pick(f"concat('{seed}:', label, ':shape:', {line})")} % {at(map_of(sizes), 'label')})"
    own = f"concat(label, '.', cast({nth} as string))"
    # Bound once a line in Spark, as every token of the line hashes it; parts that are plain text are not hashed there. The other dialect counts places from 1.
    hashed = pick(f"concat('{seed}:', k.own, ':', p.place, k.tail)" if spark else f"concat('{seed}:', {own}, ':', cast(i - 1 as string), ':', {line})")
    one_of = lambda values, n: f"element_at({values}, cast({hashed} % {n} + 1 as int))" if spark else f"list_extract({values}, cast({hashed} % {n} + 1 as int))"
    listed = lambda values: f"{'array(' if spark else '['}{', '.join(_quote(dialect, v) for v in values)}{')' if spark else ']'}"
    count = "p.n" if spark else "len(p.options)"
    host = f"case when {fresh} then {one_of(listed(OTHER_HOSTS), len(OTHER_HOSTS))} else {one_of(listed(HOSTS), len(HOSTS))} end"
    n = f"cast(p.low + {hashed} % greatest(p.span, 1) as string)"
    plain = "when p.n = 0 and p.span = 0 then '' " if spark else ""  # what follows a shape's last token
    made = f"case when p.host then {host} {plain}when p.span = 0 then {one_of('p.options', count)} when p.width = 0 then {n} else lpad({n}, p.width, p.fill) end"
    if spark:
        bound = f"named_struct('own', {own}, 'tail', concat(':', {line}))"
        return f"get(transform(array({bound}), k -> array_join(transform({at(map_of(table), 'k.own')}, p -> concat(p.before, {made})), '')), 0)"
    return f"array_to_string(list_transform({at(map_of(table), own)}, lambda p, i: {made}), '')"


def lines(numbers: DataFrame, shapes: dict[str, tuple[str, ...]] | None = None, fresh: Column | None = None, seed: int = 11, kept: Column | None = None) -> DataFrame:
    """(seq, label, fresh, ..., raw) of rows (seq, ...), labels dealt in turn; fresh lines name hosts that no other line does.

    kept is a condition on the columns but raw: other lines are left out before they are made.
    """
    shapes = KNOWN | UNKNOWN if shapes is None else shapes
    rows = numbers.select("seq", F.expr(labels_sql("spark", list(shapes), "seq")).alias("label"), (F.lit(False) if fresh is None else fresh).alias("fresh"), *(c for c in numbers.columns if c != "seq"))
    rows = rows if kept is None else rows.where(kept)
    return settled(rows.withColumn("raw", F.expr(lines_sql("spark", shapes, seed=seed))))


def make_corpus(spark: SparkSession, per_label: int, shapes: dict[str, tuple[str, ...]] | None = None, seed: int = 11, fresh: bool = False) -> DataFrame:
    """per_label lines of each label in shuffled order of arrival: (seq, label, raw). The order is by hash; seq numbers it where it is read."""
    shapes = KNOWN if shapes is None else shapes
    made = lines(spark.range(per_label * len(shapes)).select(F.col("id").alias("seq")), shapes, F.lit(fresh), seed)
    return made.select(F.xxhash64(F.lit(seed), "seq").alias("seq"), "label", "raw")
