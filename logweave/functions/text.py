"""String functions of the engine as Columns."""

from __future__ import annotations

from collections.abc import Callable, Generator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions import fixed

#: Only a line feed ends a line. Classes are those of ASCII; outer white space is trimmed as Unicode has it.
FLAGS = "(?d)"
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SEVERITY_PREFIX = rf"(?i)^\[?({'|'.join(fixed.SEVERITY_WORDS)})\]?(?![A-Za-z0-9_])"
LEFTOVER = " -:,|"
_MARK = "\x01"


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(FLAGS + pattern)


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, FLAGS + pattern, group)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use refers to it.

    The finish of an aggregate over nothing: an element of a transformed array asks for its type at every row, through all that is nested in it.
    """
    return F.aggregate(F.array(), value, lambda held, _: held, use)


def chain(steps: Generator) -> Column:
    """The result of steps, which yield a value, or several as a tuple, and get it back computed once.

    All is one expression, so no step copies the row, and what a condition leaves out is not computed.
    """

    def go(sent) -> Column:
        try:
            made = steps.send(sent)
        except StopIteration as end:
            return end.value
        if not isinstance(made, tuple):
            return let(made, lambda v: go(v))
        return let(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(made))), lambda v: go(tuple(v[f"c{i}"] for i in range(len(made)))))

    return go(None)


def one_of(c: Column, values) -> Column:
    """Whether c is one of a few values; in a lambda a hit of isin() costs an exception, up to ten values long."""
    return reduce(or_, (c == v for v in values))


def first_place(items: Column, fits: Callable[[Column, Column], Column]) -> Column:
    """Index of the first item for which fits(item, index) holds, else -1; none after it is asked."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("at"))
    step = lambda got, x: F.struct((got["n"] + 1).alias("n"), F.when((got["at"] < 0) & fits(x, got["n"]), got["n"]).otherwise(got["at"]).alias("at"))
    return F.aggregate(items, start, step, lambda got: got["at"])


def groups(c: Column, pattern: str, n: int) -> Column:
    """The n groups of a pattern that matches from the start, by one evaluation; null without a match. Groups that take no part are ''."""
    whole = pattern if pattern.endswith("$") else pattern + r"[\s\S]*$"
    return F.when(matches(c, pattern), F.split(F.regexp_replace(c, FLAGS + whole, _MARK.join(f"${i}" for i in range(1, n + 1))), _MARK, -1))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, "\x1b\\[[0-9;]*[a-zA-Z]", "")


def clean(c: Column) -> Column:
    """Without colour codes and outer white space."""
    return strip(strip_ansi(c))


def mask_line(c: Column) -> Column:
    for pattern, token in fixed.MASKS:
        c = F.regexp_replace(c, FLAGS + pattern, token)
    return c


def occurrences(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def tokens(c: Column) -> Column:
    """Number of words between white space."""
    return F.regexp_count(c, F.lit(r"\S+"))


def clip(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def after(c: Column, taken: Column) -> Column:
    """What follows a prefix, less punctuation at its start."""
    return F.ltrim(F.substring(c, F.length(taken) + 1, F.length(c)), F.lit(LEFTOVER))


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def is_json_object(c: Column) -> Column:
    """Strict: one object, no trailing text, double quotes only."""
    shaped = c.startswith("{") & c.endswith("}")
    one = F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1
    read = F.from_json(c, "map<string,string>", {"allowSingleQuotes": "false"}).isNotNull()
    return F.coalesce(shaped & F.coalesce(one, F.lit(False)) & read, F.lit(False))


def settled(df: DataFrame) -> DataFrame:
    """The same rows with every column computed once here.

    Each row passes through inline() of a one-element array, which Catalyst neither merges into later projections
    nor moves filters across, so long chains of columns are not copied into every expression that reads them.
    """
    return df.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))
