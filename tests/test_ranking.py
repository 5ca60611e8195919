"""Numbering by value and nearest rows against sorting in Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.ranking import drawn, nearest, numbered_by


@pytest.mark.parametrize("parts", [2, 7, 64])
def test_numbers_follow_the_order(spark, parts):
    r = random.Random(parts)
    rows = [(k, i, r.choice([0.5, 0.5, 0.5, None, round(r.gauss(0, 1), 2), float(r.randrange(3))])) for k in "ab" for i in range(700)] + [("c", 1, 2.0), ("d", 1, None)]
    got = numbered_by(spark.createDataFrame(rows, "k string, i long, x double").repartition(5), ["k"], "x", "i", parts=parts, tie_parts=3)
    want = [(k, i, n) for key in "abc" for n, (x, i, k) in enumerate(sorted((x, i, k) for k, i, x in rows if k == key and x is not None), 1)]
    assert sorted((x.k, x.i, x.pos) for x in got.collect()) == sorted(want) and got.columns == ["k", "i", "x", "pos"]


@pytest.mark.parametrize("k", [1, 5, 400])
def test_nearest_rows(spark, k):
    r = random.Random(k)
    pool = [(s, i, r.choice([None, round(r.random(), 2)])) for s in "ab" for i in range(150)]
    events = [(s, e, r.choice([None, -1.0, 2.0, round(r.random(), 2), r.random()])) for s in "abc" for e in range(40)]
    pf, ef = spark.createDataFrame(pool, "s string, c long, v double"), spark.createDataFrame(events, "s string, e long, v double")
    got = {}
    for x in nearest(ef, pf, ["s"], "v", "e", "c", k=k, block=0.1).orderBy("near").collect():
        got.setdefault((x.s, x.e), []).append((x.c, round(x.distance, 9)))
    for s, e, v in events:
        order = sorted((w, c) for t, c, w in pool if t == s and w is not None)
        if v is None or not order:
            assert (s, e) not in got
            continue
        place = sum(w <= v for w, _ in order)
        want = sorted((abs(v - w), n > place, abs(n - place), c) for n, (w, c) in enumerate(order, 1))[:k]
        assert got[s, e] == [(c, round(d, 9)) for d, _, _, c in want]


def test_draws_are_few_and_distinct(spark):
    near = spark.createDataFrame([("a", e, c) for e in range(5) for c in range(30)], "s string, e long, c long")
    got = drawn(near, ["s"], "e", 4, F.md5(F.concat_ws("|", "e", "c"))).collect()
    assert len({(x.e, x.c) for x in got}) == 20 and {x.draw for x in got} == {1, 2, 3, 4}
    assert len({tuple(sorted(x.c for x in got if x.e == e)) for e in range(5)}) > 1
