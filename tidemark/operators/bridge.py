"""From a statistical edge to a tradable one: costs, comparison with what a candidate is laid over, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Factors of the cost at which an expectancy is restated.
FACTORS = {"x0_5": 0.5, "x1_0": 1.0, "x1_5": 1.5, "x2_0": 2.0}
#: Gates in the order in which their reasons are given.
GATES = ("has_trades", "after_cost", "stressed", "edge_cost", "turnover")
#: What is read where a candidate has it; the rest is worked out from these or taken as not known.
OPTIONAL = {
    "after_cost": "double", "gross": "double", "stressed": "double", "cost_bps": "double", "turnover": "double", "cost_ratio": "double", "validation_bps": "double", "validation_stressed_bps": "double", "train_bps": "double",
    "validation_samples": "long", "samples": "long", "kind": "string", "base": "string", "condition": "string", "action": "string",
}


def kind_of(action: Column) -> Column:
    """`overlay` for actions that change another candidate's trades (a skipped entry, a throttle), else `standalone`."""
    name = F.lower(F.trim(F.coalesce(action, F.lit(""))))
    return F.when((name == "entry_gate_skip") | name.startswith("risk_throttle_"), "overlay").otherwise("standalone")


def _finite(name: str) -> Column:
    x = F.col(name)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def overlay_bases(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Adds `kind` where it is missing and `base`, the candidate an overlay is laid over; null for others.

    A base that is given stays. Else it is the candidate of `by` with the same condition whose action is `no_action`, the smallest id of
    several; without one the name `BASE_TEMPLATE::` and the first of `by` in small letters, which need not exist.
    """
    c = candidates.withColumn("kind", F.coalesce(F.nullif(F.trim("kind"), F.lit("")), kind_of(F.col("action"))))
    condition = F.nullif(F.trim("condition"), F.lit(""))
    group = Window.partitionBy(*by, condition)
    plain = F.min(F.when(F.col("action") == "no_action", F.nullif(F.trim("candidate_id"), F.lit("")))).over(group)
    template = F.concat(F.lit("BASE_TEMPLATE::"), F.lower(F.trim(F.coalesce(F.col(by[0]).cast("string"), F.lit("")))))
    found = F.coalesce(F.nullif(F.trim("base"), F.lit("")), F.when(condition.isNotNull(), plain), template)
    return c.withColumn("base", F.when(F.col("kind") == "overlay", found))


def bridge(candidates: DataFrame, by: list[str], edge_cost: float = 2.0, least_trades: int = 20) -> DataFrame:
    """Each candidate's edge after costs, against its base if it is an overlay, five gates and the reasons it fails.

    `candidates` has `by` (what is judged together, an event type first), candidate_id, unique within `by`, and any of OPTIONAL; what
    is missing, null, NaN or infinite is not known. Expectancies are shares of a trade, columns in `_bps` basis points. The
    cost of a trade is cost_bps times the turnover, of which at least a tenth counts; without one the share cost_ratio of the
    absolute expectancy. Without a figure under stress the one after costs stands for it. An overlay's edges are less those of its base; if that is missing from the table it fails with `missing_base` alone and has
    a score of 0. The gates: `least_trades` trades, edge above 0, edge above 0 under stress, gross edge of `edge_cost` costs,
    and one trade an event at most, no more than the base's. An empty table gives no rows.
    """
    kinds = dict(candidates.dtypes)
    c = candidates.select(*by, "candidate_id", *[(F.col(n).try_cast(t) if n in kinds else F.lit(None).cast(t)).alias(n) for n, t in OPTIONAL.items()])
    c = c.withColumns({n: _finite(n) for n, t in OPTIONAL.items() if t == "double"})
    c = overlay_bases(c, by)
    known = F.coalesce("after_cost", "gross", F.lit(0.0))
    dynamic = F.col("cost_bps") * F.greatest(F.coalesce("turnover", F.lit(0.0)), F.lit(0.1))
    share = F.abs(known) * 10_000 * F.least(F.lit(1.0), F.greatest(F.coalesce("cost_ratio", F.lit(0.0)), F.lit(0.0)))
    c = c.withColumns({"cost": F.when(F.col("cost_bps") > 0, dynamic).otherwise(share), "validation": F.coalesce(F.col("validation_bps"), known * 10_000)})
    c = c.withColumns({"under_stress": F.coalesce(F.col("validation_stressed_bps"), F.coalesce(F.col("stressed"), known) * 10_000), "train": F.coalesce("train_bps", "validation")})
    c = c.withColumns({f"edge_{n}": F.col("validation") + (1 - f) * F.col("cost") for n, f in FACTORS.items()})
    c = c.withColumn("trades", F.greatest(F.lit(0), F.coalesce("validation_samples", "samples", F.lit(0))))
    below = c.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(by)], F.col("candidate_id").alias("_id"), *[F.col(n).alias(f"_{n}") for n in ("train", "validation", "under_stress", "turnover")])
    same = F.col("base") == F.col("_id")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_b{i}"))
    c = c.join(below, same, "left")
    lost = (F.col("kind") == "overlay") & F.col("_id").isNull()
    c = c.withColumns({n: F.col(n) - F.coalesce(f"_{n}", F.lit(0.0)) for n in ("train", "validation", "under_stress")})
    c = c.withColumn("gross_edge", F.greatest(F.lit(0.0), F.col("validation") + F.col("cost")))
    turnover = F.greatest(F.coalesce("turnover", F.lit(0.0)), F.lit(0.0))
    passed = {
        "has_trades": F.col("trades") >= least_trades, "after_cost": F.col("validation") > 0, "stressed": F.col("under_stress") > 0, "edge_cost": F.col("gross_edge") >= edge_cost * F.col("cost"),
        "turnover": (turnover <= 1) & F.coalesce(turnover <= F.col("_turnover") + 1e-9, F.lit(True)) & (F.col("under_stress") > 0),
    }
    c = c.withColumns({f"gate_{g}": ~lost & passed[g] for g in GATES})
    reasons = F.when(lost, F.array(F.lit("missing_base"))).otherwise(F.array_compact(F.array(*[F.when(~F.col(f"gate_{g}"), g) for g in GATES])))
    c = c.withColumns({"tradable": F.size(reasons) == 0, "reasons": F.array_join(reasons, ","), "first_failed": F.get(reasons, F.lit(0)), "score": F.when(lost, 0.0).otherwise(F.col("validation"))})
    return c.select(
        *by, "candidate_id", "kind", "base", "trades", "cost", "train", "validation", "under_stress", "gross_edge", (F.col("gross_edge") / F.greatest("cost", F.lit(1e-9))).alias("edge_to_cost"), *[f"edge_{n}" for n in FACTORS], *[f"gate_{g}" for g in GATES], "tradable", "first_failed", "reasons", "score"
    )


def fail_summary(judged: DataFrame, by: list[str]) -> DataFrame:
    """(by, reason, candidates, first): how many candidates fail for a reason, and for how many it is the first; null for those that pass."""
    each = judged.select(*by, "first_failed", F.explode_outer(F.when(F.col("reasons") != "", F.split("reasons", ","))).alias("reason"))
    return each.groupBy(*by, "reason").agg(F.count("*").alias("candidates"), F.count_if(F.col("first_failed").eqNullSafe(F.col("reason"))).alias("first"))
