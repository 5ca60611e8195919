"""Benchmark decontamination by a prefix-filtered join of word shingles, in DataFrame functions only.

An item's windows are its runs of `window` words. Containing a window means containing all of its shingles,
so of each window's shingles, ordered by how rare they are in the documents, only the rarest one must be
looked up (the prefix, for a containment of 1, is one shingle long). A match gives the place where the
window would have to start; a start that would leave the document is dropped (positional and length
bounds), and the rest are compared word for word.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import durable

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def match_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and characters beyond ASCII; null: none."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), NOT_WORD), ""), F.array().cast("array<string>"))


def shingle_hashes(codes: Column, size: int) -> Column:
    """Hash of each run of `size` word hashes."""
    n = F.size(codes)
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.xxhash64(*[F.get(codes, i + k) for k in range(size)]))
    return F.when(n >= size, each).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(words, width, items, size, offset, code): the shingles of each distinct window with the items that have it."""
    known = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), match_words(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    windows = (
        known.where(F.size("words") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, F.lit(window)))).alias("words"))
        .groupBy("words")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("width", F.size("words"))
        .withColumn("size", F.least("width", F.lit(shingle)))
        .withColumn("codes", F.transform("words", lambda w: F.xxhash64(w)))
    )
    sized = F.coalesce(*[F.when(F.col("size") == k, shingle_hashes(F.col("codes"), k)) for k in range(1, shingle + 1)])
    return windows.select("words", "width", "items", "size", F.posexplode(sized).alias("offset", "code"))


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """`df` to be broadcast if it has at most `most` rows, else to be joined by shuffling."""
    return F.broadcast(df) if rows <= most else df


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, most_broadcast: int = 500_000) -> DataFrame:
    """doc_id, text, n_words, hits, items of every row: the words' places that lie in an occurrence of an item
    window, in order, and the sorted items whose windows occur.

    Items of fewer words than `window` are one window; items and documents that are null or have no word
    have none. Items without an id are left out; repeated items count once. Rows with a repeated or null
    id are looked at each by itself. An empty table of documents gives no rows, one of items no hits.
    Columns besides doc_id / item_id and text are ignored.
    """
    shingles = durable(item_windows(items, window, shingle))
    codes = durable(shingles.select("size", "code").distinct())
    n_shingles, n_codes = shingles.count(), codes.count()
    sizes = [r["size"] for r in codes.select("size").distinct().collect()]  # at most `shingle` numbers

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = own.withColumn("mark", F.xxhash64("text"))
    hashed = keyed.select("doc_id", "mark", F.transform(match_words(F.col("text")), lambda w: F.xxhash64(w)).alias("codes"))
    parts = [hashed.select("doc_id", "mark", F.size("codes").alias("n"), F.lit(k).alias("size"), F.posexplode(shingle_hashes(F.col("codes"), k)).alias("pos", "code")) for k in sizes]
    if not parts:
        parts = [hashed.select("doc_id", "mark", F.size("codes").alias("n"), F.lit(0).alias("size"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("code")).where("false")]
    grams = parts[0]
    for p in parts[1:]:
        grams = grams.unionByName(p)
    met = durable(grams.join(small(codes, n_codes, most_broadcast), ["size", "code"]))

    common = met.groupBy("size", "code").agg(F.count("*").alias("times"))
    every = shingles.join(small(common, n_codes, most_broadcast), ["size", "code"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    prefix = every.groupBy("words").agg(F.min(F.struct("times", "code", "offset", "size", "width", "items")).alias("rarest"))
    prefix = prefix.where("rarest.times > 0").select("words", "rarest.code", "rarest.offset", "rarest.size", "rarest.width", "rarest.items")
    start = F.col("pos") - F.col("offset")
    found = (
        met.join(small(prefix, n_shingles, most_broadcast), ["size", "code"])
        .where((start >= 0) & (start + F.col("width") <= F.col("n")))
        .groupBy("doc_id", "mark")
        .agg(F.collect_set(F.struct(start.alias("start"), "width", "words", "items")).alias("cases"))
        .select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "cases")
    )
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    split = joined.select("doc_id", "text", "cases", match_words(F.col("text")).alias("words"))
    # the size check names the words a second time, so that their list is not made anew for each comparison
    same = lambda c: (c["start"] + c["width"] <= F.size("words")) & F.forall(F.sequence(F.lit(0), c["width"] - 1), lambda k: F.get(F.col("words"), c["start"] + k) == F.get(c["words"], k))
    held = split.select("doc_id", "text", F.size("words").alias("n_words"), F.filter("cases", same).alias("cases"))
    hits = F.array_sort(F.array_distinct(F.flatten(F.transform("cases", lambda c: F.sequence(c["start"], c["start"] + c["width"] - 1)))))
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("cases", lambda c: c["items"]))))
    return held.select(
        "doc_id",
        "text",
        "n_words",
        F.coalesce(hits, F.array().cast("array<int>")).alias("hits"),
        F.coalesce(names, F.array().cast("array<string>")).alias("items"),
    )
