"""Exact quantiles by narrowing against sorted values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.functions.quantiles import exact_quantile


def values():
    r = np.random.default_rng(2)
    return {
        "normal": r.normal(size=2000),
        "wide": np.concatenate([10.0 ** r.uniform(-300, 300, 500), -(10.0 ** r.uniform(-300, 300, 500))]),
        "two": np.repeat([0.0, 1.0], [500, 500]),
        "ends": np.concatenate([np.zeros(700), r.random(3), np.ones(700)]),
        "one": np.array([3.5]),
        "near": 1 + np.arange(50) * 2.0**-52,
        "infinite": np.array([-np.inf, -1, 0, 2, np.inf]),
        "zeros": np.array([-0.0, 0.0, -0.0, 1.0]),
    }


@pytest.mark.parametrize("q", [0.5, 0.95])
def test_groups_have_their_own_quantiles(spark, q):
    rows = [(g, float(v)) for g, vs in values().items() for v in vs] + [("none", None), ("none", float("nan")), (None, 4.0), (None, 6.0)]
    got = {r["g"]: r for r in exact_quantile(spark.createDataFrame(rows, "g string, v double").repartition(7), F.col("v"), q, by=("g",), bins=1024).collect()}
    assert set(got) == {*values(), None}
    assert got[None]["quantile"] == 4 + 2 * q
    for g, vs in values().items():
        s = np.sort(vs)
        k = int(np.floor((len(s) - 1) * q))
        lo, hi = s[k], s[min(k + 1, len(s) - 1)]
        f = (len(s) - 1) * q - k
        want = lo if f == 0 or lo == hi else lo + (hi - lo) * f
        assert got[g]["n"] == len(s) and (got[g]["quantile"] == want or np.isnan(want)), g


def test_a_whole_table(spark):
    df = spark.range(100_000).select((F.hash("id") % 1000 / 7).alias("x"), F.lit(1).alias("n"))
    got = exact_quantile(df, F.col("x"), 0.3).collect()
    assert [(r["n"], r["quantile"]) for r in got] == [(100_000, df.selectExpr("percentile(x, 0.3)").first()[0])]
    assert exact_quantile(df.limit(0), F.col("x"), 0.3).collect() == []


def test_shares_outside_are_refused(spark):
    with pytest.raises(ValueError):
        exact_quantile(spark.range(1), F.col("id"), 1.5)
