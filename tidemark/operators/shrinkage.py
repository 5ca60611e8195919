"""Partial pooling of candidates' effects along a hierarchy: all, family, event, state, candidate.

Moments roll up from candidates to states, events, families: the candidates are written and grouped once, every further level
groups the units of the one below, which are written too. Effects then go down from level to level over these small tables, and meet the candidates once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import student_two_sided
from .lineage import durable
from .snapshots import adaptive_lambda


def _finite(name: str):
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _keyed(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in one spelling (`_k_` and the name; null is empty), observations, effect and the squares within."""
    n = F.greatest(F.coalesce(_finite("n"), F.lit(0.0)), F.lit(0.0))
    c = candidates.withColumns({f"_k_{k}": F.upper(F.trim(F.coalesce(F.col(k).cast("string"), F.lit("")))) for k in keys})
    c = c.withColumns({"_n": n, "_m": F.coalesce(_finite("effect"), F.lit(0.0)), "_sd": _finite("sd")})
    return durable(c.withColumn("_w", F.greatest(F.col("_n") - 1, F.lit(0.0)) * F.coalesce(F.col("_sd") ** 2, F.lit(0.0))))


def _rolled(units: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _n, _m, _w): observations, mean and sum of squares of the groups, from those of their units."""
    n = F.sum("_n")
    means = units.groupBy(*keys).agg(n.alias("_all"), F.coalesce(F.sum(F.col("_n") * F.col("_m")) / F.nullif(n, F.lit(0.0)), F.lit(0.0)).alias("_mean"))
    return units.join(means, keys).groupBy(*keys).agg(F.first("_all").alias("_n"), F.first("_mean").alias("_m"), F.sum(F.col("_w") + F.col("_n") * (F.col("_m") - F.col("_mean")) ** 2).alias("_w"))


def _levels(keyed: DataFrame, top: list[str], levels: list[str]) -> list[DataFrame]:
    """The units of all levels, from the coarsest (`top` alone) to the finest."""
    keys, units = [*top, *levels], []
    rows = keyed.select(*[F.col(f"_k_{k}").alias(k) for k in keys], "_n", "_m", "_w")
    for i in range(len(keys), len(top) - 1, -1):
        rows = durable(_rolled(rows, keys[:i]))  # each level above reads it, and twice
        units.insert(0, rows)
    return units


def _lambdas(units: list[DataFrame], top: list[str], levels: list[str], previous: dict[str, DataFrame], how: dict) -> dict[str, DataFrame]:
    out = {}
    for i, level in enumerate(levels):
        named = units[i + 1].where(F.col(level) != "") if i == len(levels) - 1 else units[i + 1]
        parent = [*top, *levels[:i]]
        own = named.select(*parent, F.col("_n").alias("n"), F.col("_m").alias("mean"), (F.col("_w") / F.greatest(F.col("_n") - 1, F.lit(1.0))).alias("var"))
        out[level] = adaptive_lambda(own, parent, previous.get(level), **how)
    return out


def level_lambdas(candidates: DataFrame, top: list[str], levels: list[str], previous: dict[str, DataFrame] | None = None, **how) -> dict[str, DataFrame]:
    """What adaptive_lambda finds at each level, by level: the tables that `previous` of a later run takes. Keys are in capitals."""
    return _lambdas(_levels(_keyed(candidates, [*top, *levels]), top, levels), top, levels, previous or {}, how)


def shrink(candidates: DataFrame, top: list[str], levels: list[str], previous: dict[str, DataFrame] | None = None, fixed: float = 100.0, **how) -> DataFrame:
    """Each candidate's effect drawn towards its state's, that towards its event's, its family's and the mean of all.

    `candidates` has the key columns `top` (what is never pooled together, as a rule and a horizon) and `levels`, from the coarsest to the finest
    (family, event, state), and effect, sd, n and p_value; spelling and blanks around keys make no difference, null keys are
    empty. An empty last level is no level: its candidates are drawn towards the level above. A level's weight is n / (n + lambda) with
    lambda as adaptive_lambda finds it for the parent, drawn towards `previous` (a table a level); with too little data the
    unit stands by itself (weight 1). A candidate's weight uses the lambda among the candidates of its state, and `fixed` where these are too few
    or one. Adds for each level effect_, weight_, lambda_ and status_ with its name, and weight, effect_shrunk, t_shrunk and p_shrunk:
    Student's two-sided p of the new effect against the candidate's own standard error, or p_value (1 if null) where n is 1
    or less or sd is not above 0. Null, NaN and infinite effects are 0, such n are 0. `how` goes to adaptive_lambda. Other columns stay
    (none may be named as those added, or as `_n`, `_m`, `_w`, `_sd`, `_above`, `_lambda` or `_k_` and a key). An empty table gives no rows.
    """
    keys = [*top, *levels]
    keyed = _keyed(candidates, keys)
    units = _levels(keyed, top, levels)
    found = _lambdas(units, top, levels, previous or {}, how)
    down = units[0].select(*top, F.col("_m").alias("_above"))
    added: list[str] = []
    for i, level in enumerate(levels):
        parent = [*top, *levels[:i]]
        lam = found[level].select(*parent, F.col("lambda").alias(f"lambda_{level}"), F.col("status").alias(f"status_{level}"))
        down = units[i + 1].select(*parent, level, "_n", "_m").join(down, parent).join(lam, parent, "left")
        weight = F.when(F.col(f"status_{level}") == "insufficient_data", 1.0).otherwise(F.coalesce(F.col("_n") / F.nullif(F.col("_n") + F.col(f"lambda_{level}"), F.lit(0.0)), F.lit(0.0)))
        if i == len(levels) - 1:
            weight = F.when(F.col(level) != "", weight).otherwise(0.0)
        down = down.withColumn(f"weight_{level}", weight)
        down = down.withColumn(f"effect_{level}", F.col(f"weight_{level}") * F.col("_m") + (1 - F.col(f"weight_{level}")) * F.col("_above"))
        added += [f"{x}_{level}" for x in ("effect", "weight", "lambda", "status")]
        down = down.select(*parent, level, *added, F.col(f"effect_{level}").alias("_above"))
    marked = [f"_k_{k}" for k in keys]
    down = down.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    own = adaptive_lambda(keyed.select(*marked, F.col("_n").alias("n"), F.col("_m").alias("mean"), (F.col("_sd") ** 2).alias("var")), marked, **how)
    own = own.select(*marked, F.when(F.col("status").isin("insufficient_data", "single_child"), fixed).otherwise(F.col("lambda")).alias("_lambda"))
    x = keyed.join(down, marked).join(own, marked)
    x = x.withColumn("weight", F.coalesce(F.col("_n") / F.nullif(F.col("_n") + F.col("_lambda"), F.lit(0.0)), F.lit(0.0)))
    x = x.withColumn("effect_shrunk", F.col("weight") * F.col("_m") + (1 - F.col("weight")) * F.col("_above"))
    error = F.when((F.col("_sd") > 0) & (F.col("_n") > 1), F.col("_sd") / F.sqrt("_n"))
    x = x.withColumn("t_shrunk", F.coalesce(F.col("effect_shrunk") / error, F.lit(0.0)))
    raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_finite("p_value"), F.lit(1.0))))
    p = F.when(error.isNotNull(), student_two_sided(F.col("t_shrunk"), F.greatest(F.col("_n") - 1, F.lit(1.0)))).otherwise(raw)
    return x.withColumn("p_shrunk", p).select(*candidates.columns, *added, F.col("_lambda").alias("lambda"), "weight", "effect_shrunk", "t_shrunk", "p_shrunk")
