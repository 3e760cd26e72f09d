"""Greedy slots in blocks against row-by-row packing."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from repolumen.operators import requestlog
from repolumen.operators.packing import assign, block_function, greedy_slots


def plain(sizes, budget, fill=None):
    slot, used, out = 0, fill or 0, []
    for k, x in enumerate(sizes):
        if (fill is not None or k) and used + x > budget:
            slot, used = slot + 1, 0
        used += x
        out.append((slot, used))
    return out


def test_block_function_and_assignment():
    rng = random.Random(1)
    for _ in range(300):
        budget = rng.randrange(1, 30)
        sizes = np.array([rng.choice([0, 1, 3, 7, 25, 60]) for _ in range(rng.randrange(1, 25))], np.int64)
        for fill in (None, 0, budget // 2, budget, budget + 9):
            want = plain(sizes.tolist(), budget, fill)
            slots, used = assign(sizes, budget, fill)
            assert list(zip(slots.tolist(), used.tolist(), strict=True)) == want
            if fill is not None:
                lines = block_function(sizes, budget)
                at = int(np.argmax(lines["upto"] > budget - fill))
                left = lines["fill"][at] + (fill if lines["slots"][at] == 0 else 0)
                assert (lines["slots"][at], left) == want[-1]


@pytest.mark.parametrize("budget", [10, 100])
def test_slots_with_a_hot_group(spark, budget):
    rng = random.Random(budget)
    rows = [("hot" if i % 4 else f"k{i % 5}", i, rng.choice([0, 2, 5, 11, 40, 130, None])) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, i long, size long").withColumn("extra", F.lit("x"))
    got = {r.i: (r.slot, r.used, r.extra) for r in greedy_slots(df, ["g"], ["i"], F.col("size"), budget, "t").collect()}
    assert len(got) == len(rows)
    for name in {r[0] for r in rows}:
        own = [(i, s or 0) for g, i, s in rows if g == name]
        for (i, s), (slot, used) in zip(own, plain([s for _, s in own], budget), strict=True):
            assert got[i] == (slot, used, "x") and (used <= budget or used == s)


def test_token_slots_of_a_dense_minute(spark):
    rows = [(i, 1 if i % 3 else 2, 1_700_000_000_000_000 + i * 20_000, i * 37 % 90) for i in range(5000)]
    df = spark.createDataFrame(rows, "event_id long, key long, at long, tokens long").withColumn("ts", F.timestamp_micros("at"))
    got = {r.event_id: (r.slot, r.used) for r in requestlog.token_slots(df, 200).collect()}
    groups = {}
    for i, key, at, tokens in rows:
        groups.setdefault((key, at // 60_000_000), []).append((i, tokens))
    for own in groups.values():
        assert [got[i] for i, _ in own] == plain([t for _, t in own], 200)
    assert requestlog.token_slots(df.limit(0), 200).count() == 0
