"""Candidates whose event sets overlap, and the greedy choice that leaves out near copies of better ones.

Sets that share more than `over` of their joint events (Jaccard) are found by prefixes: with events ordered from the rarest,
two such sets share one of the first size - ceil(over * size) + 1 events of each, so only those are joined, and events that
many sets hold are in few prefixes. Sets of equal content go through as one, whatever their number. Elements that the same
sets hold may stand as one with their number as weight (`merged`).

Sizes that Spark estimates are no guide here: a checkpoint keeps the estimate of what it came from, and that of an explode
is its input's, so a table of all members passes for a small one. All joins of members, pairs and links are merge joins.

The greedy rule (best first, drop what overlaps a kept one) is decided in rounds: a candidate is dropped once a better
neighbour is kept, and kept once all its better neighbours are dropped. The result is that of the sequential rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import durable


def merged(held: DataFrame) -> DataFrame:
    """(grp, cand, element, weight) from (grp, element, cands), each element once in a group, not null, and `cands` the sets that hold it, once each."""
    alike = held.groupBy("grp", F.sort_array("cands").alias("cands")).agg(F.min("element").alias("element"), F.count("*").alias("weight"))
    return alike.select("grp", F.explode("cands").alias("cand"), "element", "weight")


def weighed(members: DataFrame) -> DataFrame:
    return members if "weight" in members.columns else members.withColumn("weight", F.lit(1).cast("long"))


def with_places(members: DataFrame) -> DataFrame:
    """(grp, cand, element, weight) with the size of each set and what comes before each element in it, from the rarest."""
    seen = members.groupBy("grp", "element").agg(F.count("*").alias("n_sets"))
    own = Window.partitionBy("grp", "cand")
    before = F.sum("weight").over(own.orderBy("n_sets", F.xxhash64("element"), "element").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("weight")
    return weighed(members).join(seen.hint("merge"), ["grp", "element"]).withColumns({"size": F.sum("weight").over(own), "before": before})


def overlapping(members: DataFrame, over: float = 0.8, crowd: int = 1_000) -> DataFrame:
    """(grp, a, b, jaccard) with a < b: sets of one group whose Jaccard coefficient is above `over`.

    `members` has (grp, cand, element), each once, and may have a weight: how many elements one stands for, in every set
    alike. An element that is in more than `crowd` prefixes is dealt out over tasks: one side goes to one of n / crowd parts
    by hash, the other to all of them.
    """
    placed = durable(with_places(members))
    prefix = placed.where(F.col("before") <= F.col("size") - F.ceil(F.lit(over) * F.col("size") - 1e-9)).select("grp", "cand", "element", "size")
    parts = prefix.groupBy("grp", "element").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / crowd)).cast("int").alias("parts"))
    dealt = prefix.join(parts.hint("merge"), ["grp", "element"])
    left = dealt.withColumn("part", F.pmod(F.xxhash64("cand"), F.col("parts")).cast("int")).select("grp", "element", "part", F.col("cand").alias("a"), F.col("size").alias("size_a"))
    right = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("grp", "element", "part", F.col("cand").alias("b"), F.col("size").alias("size_b"))
    near = left.join(right.hint("merge"), ["grp", "element", "part"]).where("a < b").where(F.least("size_a", "size_b") > F.lit(over) * F.greatest("size_a", "size_b"))
    pairs = near.select("grp", "a", "b", "size_a", "size_b").distinct()
    # the exact number of shared events, for these pairs alone
    mine = pairs.join(placed.select("grp", F.col("cand").alias("a"), "element", "weight").hint("merge"), ["grp", "a"])
    shared = mine.join(placed.select("grp", F.col("cand").alias("b"), "element").hint("merge"), ["grp", "b", "element"]).groupBy("grp", "a", "b", "size_a", "size_b").agg(F.sum("weight").alias("n"))
    jaccard = F.col("n") / (F.col("size_a") + F.col("size_b") - F.col("n"))
    return shared.withColumn("jaccard", jaccard).where(F.col("jaccard") > over).select("grp", "a", "b", "jaccard")


def drop_near_copies(candidates: DataFrame, members: DataFrame, over: float = 0.8, rounds: int = 10_000) -> DataFrame:
    """(grp, cand, kept, duplicate_of, overlap): the sequential greedy choice within each group.

    `candidates` has (grp, cand, rank): a lower rank is better, and of equal ranks the smaller cand; `members` (grp, cand,
    element), perhaps with a weight as in `overlapping`. A candidate goes if its set's Jaccard coefficient with a kept,
    better one is above `over`; `duplicate_of` is the best such one. Repeated members count once; candidates without members
    have the empty set, and empty sets are equal. Members of unknown candidates are ignored. Rows of `candidates` are unique
    in (grp, cand), both not null.
    """
    sets = weighed(members).select("grp", "cand", "element", "weight").distinct().join(candidates.select("grp", "cand").hint("merge"), ["grp", "cand"], "left_semi")
    order = F.struct("rank", "cand")
    # equal sets: by number of elements and two sums over them that do not depend on their order
    print_of = sets.groupBy("grp", "cand").agg(F.count("*").alias("n"), F.sum(F.xxhash64("element").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64(F.lit(7), "element").cast("decimal(38,0)")).alias("y"))
    known = candidates.join(print_of.hint("merge"), ["grp", "cand"], "left").withColumn("same", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "x", "y")).drop("n", "x", "y")
    known = known.withColumn("same", F.to_json("same"))
    best = known.groupBy("grp", "same").agg(F.min(order).alias("first"))
    known = durable(known.join(best.hint("merge"), ["grp", "same"]).select("grp", "cand", "rank", F.col("first.cand").alias("head")))
    heads = known.where("cand = head").select("grp", "cand", "rank")
    pairs = overlapping(sets.join(heads.select("grp", "cand").hint("merge"), ["grp", "cand"], "left_semi"), over)
    side = lambda x: heads.select("grp", F.col("cand").alias(x), F.struct("rank", "cand").alias(f"order_{x}")).hint("merge")
    ranked = pairs.join(side("a"), ["grp", "a"]).join(side("b"), ["grp", "b"])
    better = F.col("order_a") < F.col("order_b")
    edges = durable(ranked.select("grp", F.when(better, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(better, F.col("b")).otherwise(F.col("a")).alias("v"), F.least("order_a", "order_b").alias("order_u"), "jaccard"))
    # candidates without a better neighbour are kept; the others are open
    state = edges.select("grp", F.col("u").alias("cand")).unionByName(edges.select("grp", F.col("v").alias("cand"))).distinct()
    state = durable(state.join(edges.select("grp", F.col("v").alias("cand"), F.lit(None).cast("boolean").alias("kept")).distinct().withColumn("open", F.lit(True)).hint("merge"), ["grp", "cand"], "left").select("grp", "cand", F.when(F.col("open").isNull(), F.lit(True)).alias("kept")))
    for _ in range(rounds):
        if state.where("kept is null").isEmpty():
            break
        told = edges.join(state.select("grp", F.col("cand").alias("u"), F.col("kept").alias("kept_u")).hint("merge"), ["grp", "u"])
        news = told.groupBy("grp", F.col("v").alias("cand")).agg(F.max(F.coalesce("kept_u", F.lit(False))).alias("any_kept"), F.max(F.col("kept_u").isNull()).alias("any_open"))
        now = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("any_kept"), F.lit(False)).when(~F.col("any_open"), F.lit(True))
        state = durable(state.join(news.hint("merge"), ["grp", "cand"], "left").select("grp", "cand", now.alias("kept")))
    else:
        raise RuntimeError("the choice did not settle")
    gone = edges.join(state.where("kept").select("grp", F.col("cand").alias("u")).hint("merge"), ["grp", "u"], "left_semi").groupBy("grp", F.col("v").alias("head")).agg(F.min_by(F.struct(F.col("u").alias("of"), F.col("jaccard").alias("overlap")), "order_u").alias("by"))
    out = known.join(gone.hint("merge"), ["grp", "head"], "left")
    of = F.coalesce(F.col("by.of"), F.when(F.col("cand") != F.col("head"), F.col("head")))
    return out.select("grp", "cand", of.isNull().alias("kept"), of.alias("duplicate_of"), F.when(of.isNotNull(), F.coalesce("by.overlap", F.lit(1.0))).alias("overlap"))
