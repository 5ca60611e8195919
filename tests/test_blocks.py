"""Greedy selection, as-of joins and interval flags in blocks: the same rows as loops over a key, whatever the block."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.align import active_on_grid, asof_join
from tidemark.operators.greedy import cool_down, greedy, kept_rows, space_out, step_function


def plain_greedy(rows):
    """(enter, free) rows of one key, one after the other."""
    kept, free = [], None
    for a, f in sorted(rows):
        if (free is None or a >= free) and (not kept or a > kept[-1][0]):
            kept.append((a, f))
            free = f
    return kept


def test_step_functions_chain():
    r = random.Random(1)
    for _ in range(200):
        enter = np.array(sorted(r.randrange(50) for _ in range(r.randrange(1, 30))))
        free = enter + np.array([r.randrange(-2, 20) for _ in enter])
        order = np.lexsort((free, enter))
        enter, free = enter[order], free[order]
        upto, out = step_function(enter, free)
        for begin in range(52):
            kept = kept_rows(enter, free, begin)
            k = int(np.searchsorted(upto, begin, "left"))
            if kept:
                assert max(out[k], enter[kept[-1]] + 1) == max(free[kept[-1]], enter[kept[-1]] + 1)
            else:
                assert k == len(out)


@pytest.mark.parametrize("block", [1, 7, 64, 65_536])
def test_greedy_over_blocks(spark, block):
    r = random.Random(block)
    rows = [(k, a, a + r.choice([1, 3, 5, 40, 300])) for k in ("a", "b", None) for a in (r.randrange(-100, 900) for _ in range(400))]
    odd = [("a", None, 5), ("b", 3, None)]
    df = spark.createDataFrame([(*x, "tag", 1) for x in rows + odd], "k string, enter long, free long, _block string, part int").repartition(5)
    got = greedy(df, ["k"], "enter", "free", block)
    assert got.columns == df.columns
    want = sorted((str(k), a, f) for k in ("a", "b", None) for a, f in plain_greedy([(a, f) for x, a, f in rows if x == k]))
    assert sorted((str(x.k), x.enter, x.free) for x in got.collect()) == want
    assert greedy(df.limit(0), ["k"], "enter", "free", block).count() == 0


def test_one_dense_island_of_a_million_hits(spark):
    """Every place is a hit, so nothing cuts the key; blocks do."""
    df = spark.range(1_000_000).select(F.lit("a").alias("k"), F.col("id").alias("bar"))
    kept = space_out(df, ["k"], "bar", 7)
    assert kept.agg(F.count("*"), F.max(F.col("bar") % 7), F.max("bar")).first() == (142_858, 0, 999_999)
    wide = cool_down(df.withColumn("leave", F.col("bar") + F.col("bar") % 5), ["k"], "bar", "leave", 3, block=10_000)
    bars = [x.bar for x in wide.select("bar").orderBy("bar").collect()]
    assert bars == [a for a, _ in plain_greedy([(a, a + a % 5 + 4) for a in range(1_000_000)])]


def times(values):
    return [np.datetime64("2024-01-01") + np.timedelta64(int(v), "s") for v in values]


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_in_blocks_equals_a_loop(spark, forward, strict):
    r = random.Random(forward * 2 + strict)
    left = [(i, r.choice("ab"), r.choice([None, *range(0, 4000, 5)])) for i in range(300)]
    right = [(r.choice("ab"), r.choice([None, *range(0, 4000, 5)]), r.choice([None, 1.0, 2.0, 3.0])) for _ in range(120)]
    lf, rf = spark.createDataFrame(left, "id int, k string, at long"), spark.createDataFrame(right, "k string, at long, v double")

    def plain(k, at):
        fits = [(t, v) for x, t, v in right if x == k and t is not None and at is not None and (t > at if strict else t >= at)] if forward else [(t, v) for x, t, v in right if x == k and t is not None and at is not None and (t < at if strict else t <= at)]
        if not fits:
            return None, None
        time = min(t for t, _ in fits) if forward else max(t for t, _ in fits)
        return time, max((v for t, v in fits if t == time), key=lambda v: -1.0 if v is None else v)

    want = sorted((i, *plain(k, at)) for i, k, at in left)
    for block in (10, 500, None):
        got = asof_join(lf, rf, ["k"], on="at", forward=forward, strict=strict, right_time="t", block=block)
        assert sorted(((x.id, x.t, x.v) for x in got.collect()), key=lambda x: x[0]) == want
    stamp = lambda df: df.withColumn("at", F.timestamp_seconds("at"))
    got = asof_join(stamp(lf), stamp(rf), ["k"], on="at", forward=forward, strict=strict, right_time="t", block=60).withColumn("t", F.unix_seconds("t"))
    assert sorted(((x.id, x.t, x.v) for x in got.collect()), key=lambda x: x[0]) == want


def test_asof_tolerance_counts_across_blocks(spark):
    left = spark.createDataFrame([("a", 100), ("a", 205)], "k string, at long")
    right = spark.createDataFrame([("a", 99, 1.0)], "k string, at long, v double")
    got = asof_join(left, right, ["k"], on="at", tolerance=F.lit(50), right_time="t", block=100)
    assert sorted((x.at, x.v) for x in got.collect()) == [(100, 1.0), (205, None)]


@pytest.mark.parametrize("block", [1, 30, None])
def test_flags_in_blocks_equal_a_loop(spark, block):
    r = random.Random(3)
    grid = [(k, t) for k in "ab" for t in [None, *range(0, 300, 3)]]
    spans = [(r.choice("ab"), a, r.choice([None, a - 5, a, a + 4, a + 90])) for a in (r.randrange(-50, 320) for _ in range(25))] + [("a", None, 5)]
    got = active_on_grid(spark.createDataFrame(grid, "k string, at long"), spark.createDataFrame(spans, "k string, a long, z long"), ["k"], "at", "a", "z", block=block)
    want = sorted((k, str(t), any(x == k and t is not None and None not in (a, z) and a <= t <= z for x, a, z in spans)) for k, t in grid)
    assert sorted((x.k, str(x.at), x.active) for x in got.collect()) == want


def test_no_window_spans_a_whole_key(spark):
    """The plans sort rows by key and block; only one row a block is gathered by key."""
    left = spark.createDataFrame([("a", 100)], "k string, at long")
    right = spark.createDataFrame([("a", 99, 1.0)], "k string, at long, v double")
    plan = asof_join(left, right, ["k"], on="at")._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [last(_right" in x]
    assert windows and all("_block" in x.split("], [")[1] for x in windows)
