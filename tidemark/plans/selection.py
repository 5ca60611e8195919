"""Choosing among candidates and signals: near copies dropped, ridge fits with a walk-forward penalty, gated scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import asof_join
from ..operators.overlap import drop_near_copies, merged
from ..operators.ridge import Fit, block_moments, ridge_fit, score, time_blocks
from . import panel as P
from .more_features import wide, wide_sql
from .queries import oracle_sql, queries, r6, register, s6  # noqa: F401
from .study import _FWD

# --- near copies -----------------------------------------------------------------------------------------

#: A candidate is an event type (its group) with a floor of the value; each floor is STEP above the one before.
FLOORS, STEP = 24, 4.0
_CANDIDATES = f"""c AS (SELECT event_type AS grp, j AS cand, event_id, user_id FROM events, (SELECT unnest(range({FLOORS})) AS j) WHERE event_type IS NOT NULL AND value >= j * {STEP}),
 r AS (SELECT grp, cand, CAST(sum(user_id) % 997 AS BIGINT) AS rank, count(*) AS n FROM c GROUP BY 1, 2),
 p AS (SELECT a.grp, a.cand AS u, b.cand AS v, count(*) AS n FROM c a JOIN c b ON a.grp = b.grp AND a.event_id = b.event_id AND a.cand <> b.cand GROUP BY 1, 2, 3),
 o AS (SELECT p.grp, u, v, p.n * 1.0 / (x.n + y.n - p.n) AS j FROM p JOIN r x ON x.grp = p.grp AND x.cand = u JOIN r y ON y.grp = p.grp AND y.cand = v WHERE p.n * 1.0 / (x.n + y.n - p.n) > 0.8)"""


def floored(value: str) -> Column:
    """The floors that a value reaches."""
    return F.filter(F.sequence(F.lit(0), F.lit(FLOORS - 1)), lambda j: F.col(value) >= j * STEP).cast("array<bigint>")


def candidate_sets(spark: SparkSession, d: str) -> DataFrame:
    """(grp, cand, element, weight): the events of each type at or above each floor; events that reach the same floors stand as one."""
    e = P.table(spark, d, "events").where("event_type is not null and event_id is not null")
    # of an id's rows the highest reaches the floors of all
    highest = e.groupBy(F.col("event_type").alias("grp"), F.col("event_id").alias("element")).agg(F.max("value").alias("value"))
    return merged(highest.select("grp", "element", floored("value").alias("cands")))


def candidate_ranks(spark: SparkSession, d: str) -> DataFrame:
    """(grp, cand, rank), summed over the events of the same floors first."""
    e = P.table(spark, d, "events").where("event_type is not null").select(F.col("event_type").alias("grp"), floored("value").alias("cands"), "user_id")
    alike = e.groupBy("grp", "cands").agg(F.sum("user_id").alias("user_id"))
    return alike.select("grp", F.explode("cands").alias("cand"), "user_id").groupBy("grp", "cand").agg((F.sum("user_id") % 997).alias("rank"))


@register(
    "dedupe_jaccard_greedy",
    f"""WITH RECURSIVE {_CANDIDATES}, q AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rank, cand) AS k FROM r),
 w AS (SELECT q.grp, q.cand, q.k, coalesce((SELECT list(o.u ORDER BY b.k) FROM o JOIN q b ON b.grp = o.grp AND b.cand = o.u WHERE o.grp = q.grp AND o.v = q.cand AND b.k < q.k), []) AS rivals FROM q),
 f AS (SELECT grp, 0 AS k, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT grp FROM q) UNION ALL SELECT f.grp, w.k, CASE WHEN list_has_any(f.kept, w.rivals) THEN f.kept ELSE list_append(f.kept, w.cand) END FROM f JOIN w ON w.grp = f.grp AND w.k = f.k + 1),
 z AS (SELECT grp, arg_max(kept, k) AS kept FROM f GROUP BY 1), t AS (SELECT w.grp, w.cand, list_contains(z.kept, w.cand) AS kept, list_filter(w.rivals, lambda x: list_contains(z.kept, x))[1] AS first FROM w JOIN z USING (grp))
 SELECT t.grp, t.cand, t.kept, CASE WHEN NOT t.kept THEN t.first END AS duplicate_of, CASE WHEN NOT t.kept THEN {s6('o.j')} END AS overlap FROM t LEFT JOIN o ON o.grp = t.grp AND o.u = t.first AND o.v = t.cand""",
)
def dedupe_jaccard_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Of the floors of a type the ones kept when, best first, a floor goes whose events are four fifths those of a kept one."""
    return drop_near_copies(candidate_ranks(spark, d), candidate_sets(spark, d)).select("grp", "cand", "kept", "duplicate_of", r6(F.col("overlap")).alias("overlap"))


# --- ridge -----------------------------------------------------------------------------------------------

FEATURES, LABEL, BLOCKS, PENALTIES = ["px_z", "rv_z", "basis_z"], "fwd_5m", 6, [0.001, 10.0, 1000.0, 100000.0]
_USED = " AND ".join(f"{c} IS NOT NULL" for c in [*FEATURES, LABEL])
#: Row by row: folds (0 is the fit on all rows), standardised features, their residuals, and the slopes for each penalty.
_ORTH = f"""{wide_sql(_FWD)}, known AS (SELECT symbol, ts, px_z AS a, rv_z AS b, basis_z AS c, {LABEL} AS y, (row_number() OVER (ORDER BY ts, symbol) * {BLOCKS} - 1) // count(*) OVER () AS block FROM wide WHERE {_USED}),
 folds AS (SELECT unnest(range({BLOCKS})) AS f), parts AS (SELECT k.*, f, f = 0 OR block < f AS train, f > 0 AND block = f AS test FROM known k JOIN folds ON f = 0 OR block <= f),
 m AS (SELECT f, count(*) AS n, avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb, avg(c) AS mc, stddev_samp(c) AS sc, avg(y) AS my FROM parts WHERE train GROUP BY 1),
 z AS (SELECT p.*, n, my, (a - ma) / (sa + 1e-12) AS z1, (b - mb) / (sb + 1e-12) AS z2, (c - mc) / (sc + 1e-12) AS z3 FROM parts p JOIN m USING (f)),
 s2 AS (SELECT f, sum(z1 * z2) / sum(z1 * z1) AS b21 FROM z WHERE train GROUP BY 1), o2 AS (SELECT z.*, b21, z2 - b21 * z1 AS r2 FROM z JOIN s2 USING (f)),
 s3 AS (SELECT f, sum(z1 * z3) / sum(z1 * z1) AS b31, sum(r2 * z3) / sum(r2 * r2) AS b32 FROM o2 WHERE train GROUP BY 1), o3 AS (SELECT o2.*, b31, b32, z3 - b31 * z1 - b32 * r2 AS r3 FROM o2 JOIN s3 USING (f)),
 beta AS (SELECT f, p, any_value(my) AS my, sum(z1 * y) / (sum(z1 * z1) + p) AS b1, sum(r2 * y) / (sum(r2 * r2) + p) AS b2, sum(r3 * y) / (sum(r3 * r3) + p) AS b3 FROM o3, (SELECT unnest({PENALTIES}) AS p) WHERE train GROUP BY f, p),
 ic AS (SELECT o3.f, p, CASE WHEN count(*) < 30 THEN 0 ELSE coalesce(corr(b1 * z1 + b2 * r2 + b3 * r3, y), 0) END AS ic FROM o3 JOIN beta USING (f) WHERE test AND n >= 100 GROUP BY o3.f, p HAVING count(*) >= 50),
 tried AS (SELECT t.p, coalesce(avg(ic), 0) AS mean_ic, count(ic) AS folds FROM (SELECT unnest({PENALTIES}) AS p) t LEFT JOIN ic USING (p) GROUP BY 1),
 best AS (SELECT p FROM tried ORDER BY mean_ic DESC, p LIMIT 1)"""


def orthogonal_ridge(spark: SparkSession, d: str) -> tuple[Fit, list[tuple[float, float, int]]]:
    known = wide(spark, d, _FWD).where(_USED).select("symbol", "ts", *FEATURES, LABEL)
    blocks = time_blocks(known, ["ts", "symbol"], F.date_trunc("DAY", "ts"), BLOCKS)
    return ridge_fit(block_moments(blocks, FEATURES, LABEL, BLOCKS), PENALTIES)


@register("ridge_walk_forward", f"{_ORTH} SELECT p AS penalty, {s6('mean_ic')} AS mean_ic, folds, p = (SELECT p FROM best) AS chosen FROM tried")
def ridge_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    """Each penalty's mean correlation with the label over folds that look ahead only, and which one is taken."""
    fit, tried = orthogonal_ridge(spark, d)
    return spark.createDataFrame([(p, round(ic, 6), n, p == fit.penalty) for p, ic, n in tried], "penalty double, mean_ic double, folds long, chosen boolean")


@register(
    "ridge_orthogonal",
    f"""{_ORTH}, a AS (SELECT * FROM beta WHERE f = 0 AND p = (SELECT p FROM best)), t AS (SELECT any_value(b21) AS b21, any_value(b31) AS b31, any_value(b32) AS b32 FROM o3 WHERE f = 0)
 SELECT u.feature, {s6('u.mean')} AS mean, {s6('u.sd')} AS sd, {s6('u.loses')} AS loses, {s6('u.beta')} AS beta, {s6('u.my')} AS intercept FROM (
 SELECT 'px_z' AS feature, ma AS mean, sa AS sd, 0.0 AS loses, b1 AS beta, a.my FROM a, m WHERE m.f = 0 UNION ALL SELECT 'rv_z', mb, sb, abs(b21), b2, a.my FROM a, m, t WHERE m.f = 0 UNION ALL SELECT 'basis_z', mc, sc, abs(b31) + abs(b32), b3, a.my FROM a, m, t WHERE m.f = 0) u""",
)
def ridge_orthogonal(spark: SparkSession, d: str) -> DataFrame:
    """The fit on all rows: how each feature is standardised, how much of the ones before it it loses, and its slope."""
    fit, _ = orthogonal_ridge(spark, d)
    rows = [(c, *[round(float(x), 6) + 0.0 for x in (fit.mean[i], fit.sd[i], abs(fit.steps[i]).sum(), fit.beta[i], fit.intercept)]) for i, c in enumerate(FEATURES) if fit.rows]
    return spark.createDataFrame(rows, "feature string, mean double, sd double, loses double, beta double, intercept double")


_DAYS = f"days AS (SELECT symbol, date_trunc('day', ts) + INTERVAL 1 DAY AS ts, round(avg(abs_ret), 9) AS move FROM wide WHERE abs_ret IS NOT NULL GROUP BY 1, 2), gates AS (SELECT symbol, ts, CASE WHEN move > 0.9 THEN 0.6 WHEN move < 0.6 THEN 1.2 ELSE 1.0 END AS gate FROM days)"


@register(
    "ridge_apply_gated",
    f"{_ORTH}, {_DAYS}, a AS (SELECT * FROM beta WHERE f = 0 AND p = (SELECT p FROM best)), one AS (SELECT symbol, ts, a.my + b1 * z1 + b2 * r2 + b3 * r3 AS score FROM o3, a WHERE o3.f = 0) "
    f"SELECT one.symbol, one.ts, {s6('score')} AS score, coalesce(gate, 1.0) AS gate, {s6('score * coalesce(gate, 1.0)')} AS gated FROM one ASOF LEFT JOIN gates ON gates.symbol = one.symbol AND gates.ts <= one.ts",
)
def ridge_apply_gated(spark: SparkSession, d: str) -> DataFrame:
    """The fit's score of every row, times the gate of the last whole day before it (1 without one)."""
    fit, _ = orthogonal_ridge(spark, d)
    f = wide(spark, d, _FWD)
    move = F.round(F.avg("abs_ret"), 9)
    days = f.where("abs_ret is not null").groupBy("symbol", (F.date_trunc("DAY", "ts") + F.expr("interval 1 day")).cast("timestamp_ntz").alias("ts")).agg(F.when(move > 0.9, 0.6).when(move < 0.6, 1.2).otherwise(1.0).alias("gate"))
    scored = f.where(_USED).select("symbol", "ts", score(fit, FEATURES).alias("score"))
    gated = asof_join(scored, days, ["symbol"]).withColumn("gate", F.coalesce("gate", F.lit(1.0)))
    return gated.select("symbol", "ts", r6(F.col("score")).alias("score"), "gate", r6(F.col("score") * F.col("gate")).alias("gated"))
