"""Counters with a limit on what they remember, against a table fed row by row."""

import random
from collections import OrderedDict

import pytest

from logweave.operators import mining, recency


def fed(rows, capacity, held=None):
    held, out = OrderedDict(held or {}), []
    for k in rows:
        held[k] = held.get(k, 0) + 1
        held.move_to_end(k)
        if len(held) > capacity:
            held.popitem(last=False)
        out.append(held[k])
    return out, held


@pytest.mark.parametrize("capacity,block_rows", [(1, 50), (7, 40), (30, 90), (30, 10_000)])
def test_counts_equal_a_table_fed_row_by_row(spark, capacity, block_rows):
    r = random.Random(capacity)
    keys = [f"k{min(int(r.expovariate(0.08)), 80)}" if r.random() < 0.8 else None for _ in range(600)]
    df = spark.createDataFrame([(i * 3, k) for i, k in enumerate(keys)], "seq long, k string").repartition(5)
    got = recency.recency_counts(df, ["k"], capacity, block_rows=block_rows)
    assert [r["count"] for r in got.orderBy("seq").collect()] == fed(keys, capacity)[0]


def test_what_is_left_over_goes_on(spark):
    r = random.Random(5)
    keys = [f"k{r.randrange(40)}" for _ in range(500)]
    rows = [(i, k) for i, k in enumerate(keys)]
    left, counts = None, []
    for a, b in ((0, 130), (130, 131), (131, 390), (390, 500)):
        batch = spark.createDataFrame(rows[a:b], "seq long, k string")
        got = recency.recency_counts(batch, ["k"], 12, start=left, block_rows=60)
        counts += [r["count"] for r in got.orderBy("seq").collect()]
        left = spark.createDataFrame([tuple(x) for x in recency.left_over(got, 12, start=left).collect()], recency.STATE)
        assert left.count() <= 12
    assert counts == fed(keys, 12)[0]
    assert recency.recency_counts(batch.limit(0), ["k"], 12).count() == 0


def test_quarantine_forgets_templates_and_lines_beyond_its_room(spark):
    lines = [(i, f"t{i % 3}", f"t{i % 3} x{i % 6}", "f") for i in range(60)] + [(100 + i, f"u{i}", f"u{i}", None) for i in range(4)] + [(200 + i, "t0", "t0 x0", "f") for i in range(9)]
    df = spark.createDataFrame(lines, "seq long, template string, raw string, family_guess string")
    got = {r["seq"]: r for r in mining.quarantine(df, templates=4, lines=6).collect()}
    counts, occurrences = fed([x[1] for x in lines], 4)[0], fed([x[2:] for x in lines], 6)[0]
    for (seq, *_), c, o in zip(lines, counts, occurrences):
        assert (got[seq]["count"], got[seq]["occurrences"]) == (c, o)
        assert got[seq]["kind"] == ("escalated" if o >= 5 else "quarantined" if c < 8 else "discover")
    assert got[200]["count"] == 1 and got[204]["kind"] == "escalated"  # forgotten meanwhile
