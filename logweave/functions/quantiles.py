"""Exact quantiles without sorting: the range that holds a rank is narrowed by counts until it is one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.sources.shared import cut

BINS = 2048
_STATE = ("_n", "_k", "_below", "_left", "_lo", "_hi", "_next")


def _log_scale(c: Column) -> Column:
    """Rises with c, is finite for infinities, and spreads values of all sizes alike."""
    return F.signum(c) * F.least(F.log1p(F.abs(c)), F.lit(800.0))


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Which of bins equal parts of lo to hi holds v, on a logarithmic scale while the range is wide; lo is in the first, hi in the last."""
    part = lambda x, a, b: F.least(F.lit(bins - 1), F.floor((x - a) / (b - a) * bins)).cast("int")
    a, b = _log_scale(lo), _log_scale(hi)
    return F.when(b - a > 1, part(_log_scale(v), a, b)).otherwise(part(v, lo, hi))


def exact_quantile(df: DataFrame, value: Column, q: float, by: tuple[str, ...] = (), copies: Column | None = None, bins: int = BINS) -> DataFrame:
    """Rows (by..., n, quantile): of each group the number of values and their q-quantile, interpolated between neighbours.

    Every round counts a group's values in bins of its present range, keeps least and largest value of the bin that
    holds the rank, and goes on in there; the next rank's value is in the same bin or the least of the next one. No
    task holds more of a group than its bins, however many values there are or repeat. 2048 bins need about five
    rounds for values of any spread. Null and NaN values are not counted; groups without others have no row; a null
    key is a group. A row counts copies times. A constant number of rows per group is joined with the values, or for the whole table none.
    """
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    keys = [f"_{k}" for k in by]
    value = value.cast("double")
    copies = (F.lit(1) if copies is None else copies).cast("long").alias("_w")
    rows = df.select(*(F.col(k).alias(f"_{k}") for k in by), (value + F.lit(0.0)).alias("_v"), copies).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.col("_w") > 0))
    state = rows.groupBy(*keys).agg(F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("_n > 0")
    state = state.select(*keys, "_n", F.floor((F.col("_n") - 1) * F.lit(q)).cast("long").alias("_k"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_left"), "_lo", "_hi", F.lit(None).cast("double").alias("_next"))
    state = cut(state)
    while not (open_ := state.where("_lo < _hi")).isEmpty():
        inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
        if by:
            same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
            met = rows.join(open_.withColumnsRenamed({k: f"{k}_" for k in keys}), _all([*same, inside]))
        else:
            one = open_.first()  # the only one
            met = rows.where(F.col("_v").between(one["_lo"], one["_hi"])).withColumns({c: F.lit(one[c]).cast("double" if c in ("_lo", "_hi", "_next") else "long") for c in _STATE})
        counts = met.groupBy(*keys, _bin(F.col("_v"), F.col("_lo"), F.col("_hi"), bins).alias("_bin")).agg(
            F.sum("_w").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"), *(F.first(c).alias(c) for c in ("_n", "_k", "_below", "_next"))
        )
        w = Window.partitionBy(*keys).orderBy("_bin")
        counts = counts.withColumn("_first", F.col("_below") + F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).withColumn("_after", F.lead("_a").over(w))
        found = counts.where((F.col("_first") <= F.col("_k")) & (F.col("_k") < F.col("_first") + F.col("_c")))
        found = found.select(*keys, "_n", "_k", F.col("_first").alias("_below"), F.col("_c").alias("_left"), F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.coalesce("_after", "_next").alias("_next"))
        state = cut(found.unionByName(state.where("_lo >= _hi")))
    above = F.when(F.col("_k") + 1 < F.col("_below") + F.col("_left"), F.col("_lo")).otherwise(F.coalesce("_next", "_lo"))
    share = (F.col("_n") - 1) * F.lit(q) - F.col("_k")
    between = F.when((share == 0) | (above == F.col("_lo")), F.col("_lo")).otherwise(F.col("_lo") + (above - F.col("_lo")) * share)
    return state.select(*(F.col(f"_{k}").alias(k) for k in by), F.col("_n").alias("n"), between.alias("quantile"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
