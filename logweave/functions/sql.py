"""The engine's functions for use from SQL: spark.sql("select log_mask(line) from lines").

Scalar functions are SQL functions, whose bodies Spark puts into the query, so nothing is called row by row. log_split and
log_fields are table functions that Spark evaluates as Arrow batches of their argument's rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from logweave.functions import fixed


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _mask(line: str = "line") -> str:
    for pattern, name in fixed.MASKS:
        line = f"regexp_replace({line}, {_text(pattern)}, {_text(name)})"
    return line


def _event(message: str = "message") -> str:
    cases = " ".join(f"when rlike({message}, {_text(('' if cased else '(?i)') + p)}) then {_text(name)}" for p, cased, name in fixed.EVENTS)
    return f"case {cases} else 'unknown' end"


def _severity(word: str = "word") -> str:
    plain = f"lower(trim(BOTH '[]()<> ' FROM {word}))"
    cases = " ".join(f"when {plain} in ({', '.join(map(_text, words))}) then {_text(name)}" for name, words in fixed.SEVERITIES.items())
    return f"case {cases} else 'unknown' end"


SCALARS = {
    "log_mask": ("line string", "string", _mask()),
    "log_rule_key": ("template string", "string", "concat('sih:rule:', substr(sha1(cast(template as binary)), 1, 16))"),
    "log_event": ("message string", "string", _event()),
    "log_severity": ("word string", "string", _severity()),
    "log_ip": ("line string", "string", f"nullif(regexp_extract(line, {_text(fixed.IPV4)}, 0), '')"),
}


@udtf(returnType="line_no int, line string")
class LogSplit:
    """Lines of a text that are not blank, with their place."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        for i, line in enumerate((text or "").split("\n")):
            if line.strip():
                yield i, line


@udtf(returnType="k string, v string")
class LogFields:
    """Fields of a line: those of a JSON object, else key=value pairs; the first of each key."""

    def eval(self, line: str) -> Iterator[tuple[str, str]]:
        seen: dict[str, str] = {}
        try:
            found = json.loads(line or "")
        except ValueError:
            found = None
        if isinstance(found, dict):
            seen = {k: v if isinstance(v, str) else json.dumps(v) for k, v in found.items() if v is not None}
        else:
            for k, quoted, single, bare in re.findall(fixed.LOGFMT_PAIR, line or ""):
                seen.setdefault(k, quoted or single or bare)
        yield from seen.items()


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session, as temporary ones."""
    for name, (arguments, returns, body) in SCALARS.items():
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {returns} return {body}")
    spark.udtf.register("log_split", LogSplit)
    spark.udtf.register("log_fields", LogFields)
