"""Costs, per-split tests and promotion gates of candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import ratio
from ..functions.tails import normal_two_sided

# --- tests by split --------------------------------------------------------------------------------------


def split_tests(rows: DataFrame, by: list[str], split: str, value: str, splits: list[str]) -> DataFrame:
    """(by, and for each split n, mean, t, p): the t statistic of the split's values, and its two-sided normal p.

    t and p are null with fewer than two values or no spread. Nulls and NaN are no values; other splits are ignored.
    """
    x = F.when(~F.isnan(value), F.col(value))
    own = {s: F.when(F.col(split) == s, x) for s in splits}
    sums = [c for s, v in own.items() for c in (F.count(v).alias(f"{s}_n"), F.avg(v).alias(f"{s}_mean"), F.stddev_samp(v).alias(f"_{s}"))]
    g = rows.groupBy(*by).agg(*sums)
    for s in splits:
        t = F.when((F.col(f"{s}_n") >= 2) & (F.col(f"_{s}") > 0), F.col(f"{s}_mean") / (F.col(f"_{s}") / F.sqrt(f"{s}_n")))
        g = g.withColumn(f"{s}_t", t).withColumn(f"{s}_p", normal_two_sided(t)).drop(f"_{s}")
    return g


# --- costs of a candidate --------------------------------------------------------------------------------


@dataclass(frozen=True)
class CostModel:
    """Fees and slippage in basis points, weights of the parts of a dynamic cost, and its bounds."""

    fee: float = 4.0
    slippage: float = 2.0
    spread_weight: float = 0.5
    volatility_weight: float = 0.1
    liquidity_weight: float = 0.1
    impact_weight: float = 0.1
    most_participation: float = 0.10
    least_coverage: float = 0.0
    cap: float = 150.0
    stress: float = 1.5
    least_inputs: float = 0.80
    most_ratio: float = 0.60


def turnover_of(action: Column) -> Column:
    """What share of a trade an action leaves: none where the entry is skipped, the factor of a throttle, else all of it."""
    factor = F.regexp_extract(action, r"^risk_throttle_(-?[0-9.]+)$", 1).try_cast("double")
    return F.when(action == "entry_gate_skip", 0.0).when(action.startswith("risk_throttle_"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(factor, F.lit(1.0))))).otherwise(1.0)


def candidate_costs(trades: DataFrame, by: list[str], expectancy: str, model: CostModel = CostModel()) -> DataFrame:
    """Costs of each candidate's trades, what is left of its expectancy, and four gates.

    `trades` has the candidate's columns, `expectancy` and `action` (constant in it) and spread_bps, atr, quote_volume, close,
    high, low, tob_coverage. A trade costs its fee, and half its spread, volatility, how scarce liquidity is (against the
    scarcest of the candidate's trades) and the impact of its turnover, or flat slippage where the book is not covered.
    """
    own = lambda c: F.when(~F.isnan(c), F.col(c))
    t = trades.withColumns({c: own(c) for c in ("spread_bps", "atr", "quote_volume", "close", "high", "low", "tob_coverage")}).withColumn("_turn", turnover_of(F.col("action")))
    range_bps, atr_bps = ratio(F.col("high") - F.col("low"), F.col("close")) * 1e4, ratio(F.col("atr"), F.col("close")) * 1e4
    avail = F.greatest(F.coalesce(F.nullif(F.col("quote_volume"), F.lit(0.0)), F.lit(1e6)), F.lit(1.0))
    t = t.withColumns({"_vol": F.abs(F.coalesce(atr_bps, range_bps, F.lit(0.0))), "_avail": avail})
    scarcest = t.groupBy(*by).agg(F.max(1 / F.col("_avail")).alias("_scarce"))
    t = t.join(scarcest, by)
    part = F.col("_turn") / F.col("_avail")
    penalty = F.exp(F.greatest(F.lit(0.0), F.least(F.lit(5.0), (part - model.most_participation) / model.most_participation))) - 1
    moving = (
        model.spread_weight * F.coalesce("spread_bps", F.lit(0.0)) + model.volatility_weight * F.col("_vol") + model.liquidity_weight * 10 * (1 / F.col("_avail")) / F.col("_scarce") + model.impact_weight * (10 * F.sqrt(part) + 50 * penalty)
    )
    covered = F.coalesce("tob_coverage", F.lit(0.0)) >= model.least_coverage
    cost = F.greatest(F.lit(0.0), F.least(F.lit(model.cap), model.fee + F.when(covered, moving).otherwise(model.slippage)))
    g = t.withColumn("_cost", cost).groupBy(*by).agg(
        F.first(expectancy).alias("expectancy"), F.count("*").alias("n"), F.avg("_turn").alias("turnover"), F.avg("_cost").alias("cost_bps"), F.greatest(F.avg(F.col("_cost") * F.col("_turn")) / 10_000, F.lit(0.0)).alias("cost_per_trade"),
        ((F.count("spread_bps") + F.count("quote_volume") + F.count("close") + F.count("high") + F.count("low")) / (5 * F.count("*"))).alias("coverage"),
    )
    after, stressed = F.col("expectancy") - F.col("cost_per_trade"), F.col("expectancy") - model.stress * F.col("cost_per_trade")
    share = F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.col("cost_per_trade") / F.greatest(F.lit(1e-9), F.abs("expectancy") + F.col("cost_per_trade"))))
    return g.select(*by, "n", "turnover", "cost_bps", "coverage", after.alias("after_cost"), stressed.alias("stressed"), share.alias("cost_ratio"), (after > 0).alias("gate_after_cost"), (stressed > 0).alias("gate_stressed"), (F.col("coverage") >= model.least_inputs).alias("gate_model"), (share < model.most_ratio).alias("gate_ratio"))


# --- promotion -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Promotion:
    most_q: float = 0.10
    least_events: int = 100
    least_stability: float = 0.05
    least_sign_consistency: float = 0.67
    least_cost_survival: float = 0.75
    most_control_rate: float = 0.01
    least_tob_coverage: float = 0.60
    require_audit: bool = False
    allow_missing_controls: bool = False


def promote(candidates: DataFrame, audit: DataFrame, controls: DataFrame, rule: Promotion = Promotion()) -> DataFrame:
    """Candidates with six gates, decision, track, score (the share of gates passed) and what failed.

    `candidates`: candidate_id, event_type, plan_row_id, n_events, q_value, effect, std, gate_stability, gate_delay, t_values
    (array, nulls are none), cost_gates (array of booleans, null is false), tob_coverage, validation_samples. `audit`:
    plan_row_id, executed. `controls`: event_type, rate (a null event_type holds for all others). Repeated rows of audit count as
    executed if any is, of controls the largest. The book's coverage decides the track and counts in the score, but does not
    reject; the audit rejects and is no part of the score.
    """
    audits = audit.groupBy("plan_row_id").agg(F.max("executed").alias("_executed"))
    rates = controls.groupBy("event_type").agg(F.max("rate").alias("_rate"))
    general = rates.where("event_type is null").select(F.col("_rate").alias("_any"))
    c = candidates.join(audits, "plan_row_id", "left").join(rates.where("event_type is not null"), "event_type", "left").join(F.broadcast(general.groupBy().agg(F.max("_any").alias("_any"))))
    t = F.array_compact("t_values")
    up = F.coalesce("effect", F.lit(0.0)) >= 0
    agree = F.size(F.filter(t, lambda x: (x >= 0) == up)) / F.size(t)
    sign = F.when(F.size(t) > 0, agree).otherwise(F.when(F.coalesce("gate_stability", F.lit(False)), 1.0).otherwise(0.0))
    gates = F.coalesce(F.size("cost_gates"), F.lit(0))
    survive = F.when(gates > 0, F.size(F.filter("cost_gates", lambda x: F.coalesce(x, F.lit(False)))) / gates).otherwise(0.0)
    c = c.withColumns({"sign_consistency": sign, "cost_survival": survive, "control_rate": F.coalesce("_rate", "_any")}).withColumn("stability", F.col("sign_consistency") * F.abs(F.coalesce("effect", F.lit(0.0))) / F.greatest(F.abs(F.coalesce("std", F.lit(0.0))), F.lit(1e-8)))
    lax = rule.least_stability <= 0
    stays = lambda n: F.lit(True) if lax else F.coalesce(n, F.lit(True))
    known, named = F.col("_executed").isNotNull(), F.length(F.trim(F.coalesce("plan_row_id", F.lit("")))) > 0
    failed = {  # in the order in which the first one is named
        "statistical_q_value": F.coalesce("q_value", F.lit(1.0)) > rule.most_q,
        "statistical_min_events": F.coalesce("n_events", F.lit(0)) < rule.least_events,
        "stability_gate": ~stays("gate_stability"),
        "stability_score": F.col("stability") < rule.least_stability,
        "stability_sign_consistency": F.col("sign_consistency") < rule.least_sign_consistency,
        "delay_robustness_fail": ~stays("gate_delay"),
        "cost_survival": F.col("cost_survival") < rule.least_cost_survival,
        "negative_control_missing": F.col("control_rate").isNull() & F.lit(not rule.allow_missing_controls),
        "negative_control_fail": F.coalesce(F.col("control_rate") > rule.most_control_rate, F.lit(False)),
        "hypothesis_not_executed": named & known & ~F.coalesce("_executed", F.lit(False)),
        "hypothesis_missing_audit": named & ~known & F.lit(rule.require_audit),
        "hypothesis_missing_plan_row_id": ~named & F.lit(rule.require_audit),
        "no_validation_samples": F.coalesce("validation_samples", F.lit(0)) <= 0,
    }
    c = c.withColumns({f"_f_{n}": x for n, x in failed.items()})
    passes = lambda *names: ~F.array_contains(F.array(*[F.col(f"_f_{n}") for n in names]), True)
    c = c.withColumns(
        {
            "gate_statistical": passes("statistical_q_value", "statistical_min_events"),
            "gate_stable": passes("stability_gate", "stability_score", "stability_sign_consistency", "delay_robustness_fail"),
            "gate_cost": passes("cost_survival"),
            "gate_control": passes("negative_control_missing", "negative_control_fail"),
            "gate_audit": passes("hypothesis_not_executed", "hypothesis_missing_audit", "hypothesis_missing_plan_row_id"),
            "gate_oos": passes("no_validation_samples"),
            "gate_tob": F.coalesce("tob_coverage", F.lit(0.0)) >= rule.least_tob_coverage,
        }
    )
    scored = ["gate_statistical", "gate_stable", "gate_cost", "gate_control", "gate_tob", "gate_oos"]
    promoted = F.col("gate_statistical") & F.col("gate_stable") & F.col("gate_cost") & F.col("gate_control") & F.col("gate_audit") & F.col("gate_oos")
    reasons = F.array_compact(F.array(*[F.when(F.col(f"_f_{n}"), F.lit(n)) for n in failed]))
    return c.select(
        "candidate_id", "event_type", promoted.alias("promoted"), F.when(promoted & F.col("gate_tob"), "standard").otherwise("fallback_only").alias("track"), (sum(F.col(g).cast("int") for g in scored) / len(scored)).alias("score"), "sign_consistency", "stability", "cost_survival", "control_rate",
        *scored[:4], "gate_audit", *scored[4:], F.get(reasons, F.lit(0)).alias("first_failed"), F.array_join(F.array_sort(reasons), "|").alias("reasons"),
    )
