"""Candidates pooled along the whole hierarchy, with the pooling strengths of an earlier run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shrinkage import level_lambdas, shrink
from . import panel as P
from .queries import oracle_sql, queries, r6, register, s6  # noqa: F401

TOP, LEVELS = ["verb", "horizon"], ["family", "event", "state"]
#: Line items as candidates; those shipped before the date are what an earlier run saw.
_KEYS = {
    "verb": "l_linestatus",
    "horizon": "CASE WHEN l_linenumber > 4 THEN 'LONG' ELSE 'SHORT' END",
    "family": "l_returnflag",
    "event": "l_returnflag || CAST(l_suppkey % 3 AS {text})",
    "state": "CASE WHEN l_partkey % 4 > 0 THEN 'S' || CAST(l_partkey % 4 AS {text}) END",
    "symbol": "CAST(l_suppkey % 5 AS {text})",
}
_CUT = "1998-01-01"


def _candidates(line: DataFrame) -> DataFrame:
    g = line.groupBy(*[F.expr(t.format(text="STRING")).alias(k) for k, t in _KEYS.items()])
    return g.agg(F.count("*").alias("n"), (F.avg("l_discount") - 0.05).alias("effect"), F.stddev_samp("l_discount").alias("sd")).withColumn("p_value", F.lit(None).cast("double"))


def _level_sql(x: str, when: str, previous: str | None) -> str:
    """Tables of one run: candidates `x`, units `x_u0` ..., strengths `x_l0` ... of their parents, all from the candidates."""
    keys = [*TOP, *LEVELS]
    out = [f"{x} AS (SELECT {', '.join(t.format(text='VARCHAR') + ' AS ' + k for k, t in _KEYS.items() if k != 'state')}, coalesce({_KEYS['state'].format(text='VARCHAR')}, '') AS state, count(*) AS n, avg(l_discount) - 0.05 AS effect, coalesce(stddev_samp(l_discount), 0) AS sd FROM lineitem WHERE l_shipdate {when} GROUP BY ALL)"]
    for i in range(len(LEVELS) + 1):
        by = ", ".join(keys[: len(TOP) + i])
        out.append(f"{x}_m{i} AS (SELECT {by}, sum(n) AS un, sum(n * effect) / sum(n) AS um FROM {x} GROUP BY {by})")
        out.append(f"{x}_u{i} AS (SELECT {by}, any_value(un) AS un, any_value(um) AS um, sum((n - 1) * sd * sd + n * (effect - um) * (effect - um)) / greatest(any_value(un) - 1, 1) AS uv FROM {x} JOIN {x}_m{i} USING ({by}) GROUP BY {by})")
    out.append(f"{x}_u4 AS (SELECT verb, horizon, family, event, state, symbol, n AS un, effect AS um, sd * sd AS uv FROM {x})")
    for i in range(len(LEVELS) + 1):
        by, named = ", ".join(keys[: len(TOP) + i]), " WHERE state <> ''" if i == len(LEVELS) - 1 else ""
        out.append(f"{x}_c{i} AS (SELECT {by}, sum(un) AS pn, count(*) AS kids, sum(un * um) / sum(un) AS pm FROM {x}_u{i + 1}{named} GROUP BY {by})")
        out.append(f"{x}_r{i} AS (SELECT {by}, any_value(pn) AS pn, any_value(kids) AS kids, greatest(5, least(5000, sum((un - 1) * uv) / greatest(sum(un - 1), 1) / greatest(sum(un * (um - pm) * (um - pm)) / any_value(pn), 1e-8))) AS ratio FROM {x}_u{i + 1} JOIN {x}_c{i} USING ({by}){named} GROUP BY {by})")
        raw = f"{x}_b{i} AS (SELECT {by}, CASE WHEN pn < 200 THEN 'insufficient_data' WHEN kids = 1 THEN 'single_child' ELSE 'adaptive' END AS status, CASE WHEN pn < 200 THEN 0 WHEN kids = 1 THEN 5000 ELSE ratio END AS lam FROM {x}_r{i})"
        out.append(raw)
        if previous and i < len(LEVELS):
            known = "b.status = 'adaptive' AND p.lam > 0"
            out.append(f"{x}_l{i} AS (SELECT b.* REPLACE (CASE WHEN {known} THEN 'adaptive_smoothed' ELSE b.status END AS status, CASE WHEN {known} THEN greatest(0.5 * p.lam, least(1.5 * p.lam, 0.9 * p.lam + 0.1 * b.lam)) ELSE b.lam END AS lam) FROM {x}_b{i} b LEFT JOIN {previous}_l{i} p USING ({by}))")
        else:
            out.append(f"{x}_l{i} AS (SELECT * FROM {x}_b{i})")
    return ",\n ".join(out)


def _down_sql() -> str:
    keys, out = [*TOP, *LEVELS], ["d0 AS (SELECT *, um AS eff0 FROM n_u0)"]
    for i, level in enumerate(LEVELS):
        here, above = ", ".join(keys[: len(TOP) + i + 1]), ", ".join(keys[: len(TOP) + i])
        blank = "WHEN state = '' THEN 0.0 " if level == "state" else ""
        kept = "".join(f", d{i}.{c}_{done}" for done in LEVELS[:i] for c in ("e", "w", "l", "s"))
        out.append(f"w{i} AS (SELECT {', '.join(('d' if c in keys[: len(TOP) + i] else 'u') + '.' + c for c in keys[: len(TOP) + i + 1])}, u.um, d.eff{i}{kept.replace(f'd{i}.', 'd.')}, l.lam AS l_{level}, l.status AS s_{level}, CASE {blank}WHEN l.status = 'insufficient_data' THEN 1.0 ELSE u.un / (u.un + l.lam) END AS w_{level} FROM n_u{i + 1} u JOIN d{i} d USING ({above}) LEFT JOIN n_l{i} l USING ({above}))")
        out.append(f"d{i + 1} AS (SELECT *, w_{level} * um + (1 - w_{level}) * eff{i} AS e_{level}, w_{level} * um + (1 - w_{level}) * eff{i} AS eff{i + 1} FROM w{i})")
    return ",\n ".join(out)


_SHOWN = [f"{c}_{level}" for level in LEVELS for c in ("effect", "weight", "lambda", "status")]


@register(
    "shrinkage_levels",
    f"""WITH {_level_sql("o", f"< DATE '{_CUT}'", None)},
 {_level_sql("n", f">= DATE '{_CUT}'", "o")},
 {_down_sql()}, f AS (SELECT n.*, {", ".join(f"{a}_{level} AS {b}_{level}" for level in LEVELS for a, b in (("e", "effect"), ("w", "weight"), ("l", "lambda"), ("s", "status")))}, eff3, CASE WHEN b.status = 'adaptive' THEN b.lam ELSE 100 END AS lam FROM n JOIN d3 USING (verb, horizon, family, event, state) JOIN n_b3 b USING (verb, horizon, family, event, state)),
 g AS (SELECT *, n / (n + lam) AS weight, n / (n + lam) * effect + lam / (n + lam) * eff3 AS eff FROM f)
SELECT verb, horizon, family, event, nullif(state, '') AS state, symbol, n, {", ".join(c if c.startswith("status") else s6(c) + " AS " + c for c in _SHOWN)}, {s6("lam")} AS lambda, {s6("weight")} AS weight, {s6("eff")} AS effect_shrunk, {s6("CASE WHEN sd > 0 AND n > 1 THEN eff / (sd / sqrt(n)) ELSE 0 END")} AS t_shrunk FROM g""",
)
def shrinkage_levels(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the later years, pooled with strengths drawn towards those of the years before."""
    line = P.table(spark, d, "lineitem")
    earlier = F.col("l_shipdate") < F.lit(_CUT).cast("date")
    before = level_lambdas(_candidates(line.where(earlier)), TOP, LEVELS)
    out = shrink(_candidates(line.where(~earlier)), TOP, LEVELS, before)
    return out.select(*TOP, *LEVELS, "symbol", "n", *[F.col(c) if c.startswith("status") else r6(F.col(c)).alias(c) for c in [*_SHOWN, "lambda", "weight", "effect_shrunk", "t_shrunk"]])
