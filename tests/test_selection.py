"""Greedy choice among overlapping sets and ridge fits, against plain Python and numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.overlap import drop_near_copies, merged, overlapping, with_places
from tidemark.operators.ridge import block_moments, fit_moments, ridge_fit, score, time_blocks, walk_forward


def plain_choice(ranks, sets, over):
    out, kept = {}, []
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for rank, c in sorted((r, c) for c, r in ranks.items()):
        first = next(((k, jaccard(sets[c], sets[k])) for k in kept if jaccard(sets[c], sets[k]) > over), None)
        if first is None:
            kept.append(c)
        out[c] = (first is None, *(first or (None, None)))
    return out


@pytest.mark.parametrize("over", [0.5, 0.8])
def test_choice_is_the_sequential_rule(spark, over):
    r = random.Random(int(over * 10))
    ranks, sets = {}, {}
    for g in ("x", "y"):
        base = [r.randrange(1000) for _ in range(60)]
        for c in range(60):
            kind = r.randrange(5)
            own = set(base[: r.randrange(1, 60)]) if kind < 3 else {r.randrange(1000) for _ in range(20)} if kind == 3 else set()
            ranks[g, c], sets[g, c] = r.randrange(20), own
        for c in range(60, 70):  # equal sets and a chain of overlaps
            ranks[g, c], sets[g, c] = r.randrange(20), sets[g, 0] if c < 65 else set(range(c, c + 40))
    cands = spark.createDataFrame([(g, c, k, "clash") for (g, c), k in ranks.items()], "grp string, cand long, rank long, element string").repartition(4)
    members = spark.createDataFrame([(g, c, e) for (g, c), s in sets.items() for e in [*s, *list(s)[:3]]] + [("x", 999, 1)], "grp string, cand long, element long").repartition(4)
    got = {(x.grp, x.cand): (x.kept, x.duplicate_of, x.overlap) for x in drop_near_copies(cands, members, over).collect()}
    for g in ("x", "y"):
        want = plain_choice({c: k for (h, c), k in ranks.items() if h == g}, {c: s for (h, c), s in sets.items() if h == g}, over)
        assert {c: (got[g, c][0], got[g, c][1], pytest.approx(got[g, c][2])) for c in want} == want
    assert drop_near_copies(cands.limit(0), members, over).count() == 0
    assert drop_near_copies(cands, members.limit(0), over).where("kept").count() == 2  # all sets are empty: one a group


def test_crowded_elements_are_dealt_out(spark):
    sets = {c: set(range(100)) | {1000 + c} for c in range(40)} | {99: {1}}
    members = spark.createDataFrame([("g", c, e) for c, s in sets.items() for e in s], "grp string, cand long, element long")
    want = sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.8)
    for crowd in (3, 1000):
        got = overlapping(members, 0.8, crowd)
        assert sorted((x.a, x.b) for x in got.collect()) == want and len(want) == 780


def test_members_are_never_broadcast(spark, capsys):
    """Spark takes 150,000 exploded members for 160 kB, as the estimate is that of the 10,000 rows before: joins may not go by it."""
    members = spark.range(10_000).select(F.lit("g").alias("grp"), F.explode(F.sequence(F.lit(1), F.lit(15))).alias("cand"), F.col("id").alias("element")).where("element % 50 >= cand")
    with_places(members).explain()
    got = overlapping(members)
    got.explain()
    assert "Broadcast" not in capsys.readouterr().out
    n = {c: sum(e % 50 >= c for e in range(10_000)) for c in range(1, 16)}
    assert sorted((x.a, x.b) for x in got.collect()) == sorted((a, b) for a in n for b in n if a < b and n[b] / n[a] > 0.8)


def test_elements_that_the_same_sets_hold_stand_as_one(spark):
    r = random.Random(4)
    held = {(g, e): sorted(r.sample(range(8), r.randrange(9))) if e % 7 == 0 else list(range(r.choice([1, 5, 7, 8]))) for g in "xy" for e in range(300)}
    nested = spark.createDataFrame([(g, e, r.sample(c, len(c))) for (g, e), c in held.items()], "grp string, element long, cands array<long>").repartition(3)
    few = merged(nested)
    kinds = {(g, tuple(c)) for (g, _), c in held.items()}
    assert few.count() == sum(len(c) for _, c in kinds) and few.agg(F.sum("weight")).first()[0] == sum(map(len, held.values()))
    long = nested.select("grp", F.explode("cands").alias("cand"), "element")
    assert sorted(overlapping(few).collect()) == sorted(overlapping(long).collect()) != []
    cands = spark.createDataFrame([(g, c, r.randrange(4)) for g in "xy" for c in range(9)], "grp string, cand long, rank long")
    assert sorted(drop_near_copies(cands, few).collect(), key=str) == sorted(drop_near_copies(cands, long).collect(), key=str)


def plain_fit(x, y, penalty):
    mean, sd = x.mean(0), x.std(0, ddof=1)
    z = (x - mean) / (sd + 1e-12)
    o, steps = z.copy(), []
    for j in range(1, z.shape[1]):
        b = np.linalg.lstsq(o[:, :j], o[:, j], rcond=None)[0]
        o[:, j] -= o[:, :j] @ b
        steps.append(b)
    beta = np.linalg.solve(o.T @ o + penalty * np.eye(z.shape[1]), o.T @ y)

    def predict(x):
        o = (x - mean) / (sd + 1e-12)
        for j, b in enumerate(steps, 1):
            o[:, j] -= o[:, :j] @ b
        return y.mean() + o @ beta

    return predict


@pytest.fixture(scope="module")
def panel(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(900, 5)) @ g.normal(size=(5, 5)) + 1000
    y = 0.02 * x[:, 0] - 0.01 * x[:, 3] + g.normal(size=900)
    rows = [(f"s{i % 3}", i // 3, *map(float, x[i]), float(y[i])) for i in range(900)]
    odd = [("s0", 5000, None, *[1.0] * 5), ("s0", 5001, *[1.0] * 5, float("nan"))]
    df = spark.createDataFrame(rows + odd, "symbol string, at long, a double, b double, c double, d double, e double, y double").repartition(4)
    return df, x, y


def test_blocks_are_equal_along_time(panel):
    df, x, _ = panel
    got = time_blocks(df.where("at < 5000"), ["at", "symbol"], F.floor(F.col("at") / 50), 7).orderBy("at", "symbol").collect()
    cuts = np.linspace(0, 900, 8, dtype=int)
    assert [r.block for r in got] == [int(np.searchsorted(cuts, i, "right")) - 1 for i in range(900)] and "_bucket" not in got[0].asDict()


def test_ridge_equals_numpy(panel):
    df, x, y = panel
    names = list("abcde")
    blocks = time_blocks(df.where("at < 5000"), ["at", "symbol"], F.floor(F.col("at") / 50), 6)
    m = block_moments(blocks.unionByName(df.where("at >= 5000").withColumn("block", F.lit(0))), names, "y", 6)
    assert m[:, 0, 0].tolist() == [150.0] * 6 and np.allclose(m.sum(0)[1:-1, -1], x.T @ y, rtol=1e-10)
    for penalty in (0.001, 50.0):
        fit, want = fit_moments(m.sum(0), penalty), plain_fit(x, y, penalty)
        w = fit.weights()
        assert np.allclose(w[0] + x @ w[1:], want(x), atol=1e-7)
        got = df.where("at < 5000").select("symbol", "at", score(fit, names).alias("s")).orderBy("at", "symbol").collect()
        assert np.allclose([r.s for r in got], want(x), atol=1e-7)
    tried = walk_forward(m, [0.001, 50.0, 5000.0])
    for p, ic, n in tried:
        each = [np.corrcoef(plain_fit(x[: 150 * b], y[: 150 * b], p)(x[150 * b : 150 * (b + 1)]), y[150 * b : 150 * (b + 1)])[0, 1] for b in range(1, 6)]
        assert n == 5 and ic == pytest.approx(np.mean(each), abs=1e-8)
    assert ridge_fit(m, [0.001, 50.0, 5000.0])[0].penalty == max(tried, key=lambda t: t[1])[0]


def test_ridge_without_variation_or_rows():
    m = np.zeros((3, 4, 4))
    m[:, 0, 0] = 60
    fit, tried = ridge_fit(m, [1.0])
    assert not fit.beta.any() and tried == [(1.0, 0.0, 1)]
    twin = np.ones((50, 1)) * [1, 1] * np.arange(50)[:, None]
    a = np.column_stack([np.ones(50), twin, np.arange(50)])
    assert np.isfinite(fit_moments(a.T @ a, 0.1).beta).all()
