"""Timestamps of many layouts as one ladder of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions import fixed
from logweave.functions.text import SEVERITY_PREFIX, WHITE, let, matches, strip

#: Magnitudes of epochs in seconds, milli-, micro- and nanoseconds: (digits, low, high, microseconds per unit as a fraction).
EPOCHS = ((10, 10**8, 41 * 10**8, 10**6, 1), (13, 10**11, 41 * 10**11, 10**3, 1), (16, 10**14, 41 * 10**14, 1, 1), (19, 10**17, 41 * 10**17, 1, 10**3))
_REST = r"((?:[T\s]\s*\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?.*)?)$"
_MONTH = "(" + "|".join(fixed.MONTHS) + ")[a-z]*"
#: Rewrites of one layout each into year-month-day, then of zones; text that does not fit stays as it is. Y stands for a missing year.
_REWRITES = (
    (r"""^[\s\S]*"\$date"\s*:\s*"([^"]+)"[\s\S]*$""", "$1"),
    (r"(\d{2}:\d{2}:\d{2}),(\d{1,6})", "$1.$2"),
    (rf"(?i)^(\d{{1,2}})[/\s-]{_MONTH}[/\s-](\d{{4}}){_REST}", "$3-$2-$1$4"),
    (rf"(?i)^(\d{{1,2}})[/\s-]{_MONTH}[/\s-](\d{{4}}):(\d.*)$", "$3-$2-$1 $4"),
    (rf"(?i)^{_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}}){_REST}", "$3-$1-$2$4"),
    (rf"(?i)^{_MONTH}\s+(\d{{1,2}}){_REST}", "Y-$1-$2$3"),
    (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}){_REST}", "$1-$2-$3$4"),
    (rf"^(1[3-9]|2\d|3[01])/(\d{{1,2}})/(\d{{4}}|\d{{2}}){_REST}", "$3-$2-$1$4"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}){_REST}", "$3-$1-$2$4"),
    (r"^(\d{2})-(\d{1,2}-\d{1,2})(?=$|[T\s])", "20$1-$2"),
    (r"^(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:\D.*)?)$", "Y-1-1 $1"),
    (r"\s*(?:Z|UTC|GMT)$", "+00:00"),
    (r"(\d)\s*([+-]\d{2}):?(\d{2})$", "$1$2:$3"),
    (r"(:\d{2}(?:\.\d+)?(?:[+-]\d{2}:\d{2})?)\s+[A-Z]{3,4}$", "$1"),
    (r"[T\s]+(\d{1,2}:)", " $1"),
)
_NAMED = slice(2, 6)  # those with the name of a month
_CANONICAL = r"^(?:Y|\d{4})-\d{1,2}-\d{1,2}(?: \d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:[+-]\d{2}:\d{2})?)?$"
#: Read by a cast as it stands.
_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?\z"


def from_epoch(v: Column) -> Column:
    """Of a number, by its magnitude."""
    out = F.lit(None).cast("timestamp")
    for _, low, high, by, over in reversed(EPOCHS):
        out = F.when(v.between(low, high), F.timestamp_micros(F.round(v * by / over).cast("long"))).otherwise(out)
    return out


# The ladder is one SQL expression, parsed once a use: built of Columns it takes hundreds of calls to the JVM each time.


def _raw(pattern: str) -> str:
    """The pattern as an SQL literal without escapes."""
    quote = "'" if '"' in pattern else '"'
    return f"r{quote}{pattern}{quote}"


def _bare(s: str) -> str:
    return f"""btrim(btrim({s}, '{WHITE}'), '[]"\\'()')"""


def _bind(value: str, name: str, body: str) -> str:
    return f"aggregate(array(), {value}, (held, _e) -> held, {name} -> {body})"  # as functions.text.let


def _rewritten(s: str, rewrites) -> str:
    for pattern, new in rewrites:
        s = f"regexp_replace({s}, {_raw(pattern)}, {_raw(new)})"
    return s


def _from_digits(s: str) -> str:
    """Of a digit string, by its length."""
    by_length = " ".join(f"when length({s}) = {digits} and v between {low} and {high} then timestamp_micros(cast((v - pmod(v, {over})) / {over} * {by} as bigint))" for digits, low, high, by, over in EPOCHS)
    return _bind(f"try_cast({s} as bigint)", "v", f"case {by_length} end")


def _canonical(s: str) -> str:
    """The text with its layout brought to year-month-day time zone, months as numbers; layouts with a month's name are tried where there is one."""
    named = f"c rlike {_raw('(?i)' + '|'.join(fixed.MONTHS))}"
    start, middle = _rewritten(_bare(s), _REWRITES[: _NAMED.start]), _rewritten("c", _REWRITES[_NAMED])
    dated = _bind(start, "c", f"case when {named} then {middle} else c end")
    lowered = f"lower(regexp_replace({_rewritten(dated, _REWRITES[_NAMED.stop :])}, '^Y-', '0-'))"
    numbered = "c"
    for i, name in enumerate(fixed.MONTHS, 1):
        numbered = f"replace({numbered}, '-{name}-', '-{i}-')"
    return f"regexp_replace({_bind(lowered, 'c', f'case when {named} then {numbered} else c end')}, '^0-', 'Y-')"


def _dated(c: str) -> str:
    """Of a canonical text; a missing year is that of r.now, or the one before if that lies more than a day ahead."""
    in_year = lambda y: f"try_cast(concat(cast({y} as string), substring({c}, 2)) as timestamp)"
    yearless = _bind(in_year("year(r.now)"), "t", f"case when t > r.now + interval 1 day then {in_year('year(r.now) - 1')} else t end")
    return f"case when not {c} rlike {_raw(_CANONICAL)} then null when startswith({c}, 'Y') then {yearless} else try_cast({c} as timestamp) end"


def _ladder() -> str:
    """A lambda over r, a struct of v and now."""
    hint = rf"s rlike r'\d' and (s rlike r'[-/:T\s]' or s rlike '(?i)(?:{'|'.join(fixed.MONTHS)})')"
    fraction = "case when try_cast(s as double) between 1e8D and 4.1e9D then timestamp_micros(cast(round(try_cast(s as double) * 1e6D) as bigint)) end"
    steps = rf"when s rlike {_raw(_ISO)} then try_cast(s as timestamp) when s rlike '^[0-9]+$' then {_from_digits('s')} when s rlike r'^[0-9]{{9,11}}\.[0-9]+$' then {fraction} when {hint} then {_bind(_canonical('s'), 'd', _dated('d'))}"
    return f"r -> {_bind(_bare('r.v'), 's', f'case {steps} end')}"


_LADDER = _ladder()


def parse_ts(value: Column, now: Column) -> Column:
    """TIMESTAMP of a text, null if it has none of the known layouts. now settles missing years and is always passed in."""
    return F.call_function("aggregate", F.array(), F.struct(value.alias("v"), now.alias("now")), F.expr("(held, _e) -> held"), F.expr(_LADDER))


def render(ts: Column) -> Column:
    """ISO 8601 in UTC with Z; microseconds only if there are any. The session's time zone must be UTC."""

    def shown(t: Column) -> Column:
        whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
        part = F.pmod(F.unix_micros(t), F.lit(1_000_000))
        return F.concat(whole, F.when(part == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))), F.lit("Z"))

    return let(ts, shown)


def looks_like_time_or_severity(field: Column, now: Column) -> Column:
    f = strip(field)
    return (f != "") & (parse_ts(f, now).isNotNull() | matches(f, SEVERITY_PREFIX))
