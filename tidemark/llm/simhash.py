"""SimHash near-duplicates, found by anchor-point covering.

The 64 bits are split into blocks. Two fingerprints that differ in at most `threshold` bits differ in at
most threshold // blocks bits of some block. In each block the anchors are the points of a covering code:
a perfect Hamming code on 2**r - 1 of the bits, which has covering radius 1, and all values of the other
bits. Each fingerprint lives at its one anchor within the covering radius and is replicated to every
anchor at which a fingerprint within the block's threshold may live (all within radius plus threshold but
those that none can reach). Fingerprints are then compared per anchor on all 64 bits.

Equal fingerprints are merged beforehand. Anchors with very many fingerprints are split into slices that
meet all visitors. A cell sends on a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key
from .components import connected_components, durable
from .substring_dedup import mix


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half the XXH64 values of the word shingles (no word: 0)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]].tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    n = max(len(words) - shingle + 1, 1)
    reach = min(shingle, len(words)) - 1
    h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[:n], ends[reach:], strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 100_000):
        ones += np.unpackbits(h[i : i + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) and text_hash (XXH64 of the text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], ["doc_id", "fp", "text_hash"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp long, text_hash long")


@lru_cache
def orders(bits: int) -> np.ndarray:
    """Odd factors, each of which puts hashes in an order of its own."""
    return np.random.default_rng(42).integers(1, 1 << 63, bits, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(text: str | None, shingle: int = 5, bits: int = 128, seed: int = 42) -> np.ndarray:
    """`bits` bits as bytes: a bit of the first word shingle's hash in each of as many orders.

    Texts that share a part s of all their shingles agree in (1 + s) / 2 of the bits on average. A text without a word
    has zeros, one with fewer words than a shingle is one shingle.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(bits // 8, np.uint8)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(b" ".join(words[i : i + shingle]), seed) for i in range(max(len(words) - shingle + 1, 1))], np.uint64)
    least = np.full(bits, np.iinfo(np.uint64).max)
    for i in range(0, len(h), 8192):
        np.minimum(least, (h[i : i + 8192, None] * orders(bits)[None, :]).min(axis=0), out=least)
    return np.packbits((mix(least) & np.uint64(1)).astype(np.uint8))


def checked_fingerprints(docs: DataFrame, shingle: int, check_shingle: int) -> DataFrame:
    """fingerprints with the two halves of a 128-bit signature, and `node`, a hash of all three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
            halves = np.array([signature(t, check_shingle) for t in texts], np.uint8).reshape(-1, 16).copy().view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], ["doc_id", "text_hash", "fp", "c1", "c2"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, fp long, c1 long, c2 long").withColumn("node", F.xxhash64("fp", "c1", "c2"))


def block_bounds(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block of the 64."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache
def covering_code(bits: int) -> int:
    """Length of the longest perfect Hamming code that fits in `bits` bits."""
    r = 1
    while 2 ** (r + 1) - 1 <= bits:
        r += 1
    return 2**r - 1


def homes(part: np.ndarray, bits: int) -> np.ndarray:
    """The anchor of each block value: a bit of the code's share is flipped where its syndrome is not zero."""
    length = covering_code(bits)
    syndrome = np.zeros(part.shape, np.uint64)
    for i in range(length):
        syndrome ^= np.where(part >> np.uint64(i) & np.uint64(1), np.uint64(i + 1), np.uint64(0))
    flip = np.where(syndrome > 0, np.uint64(1) << (np.maximum(syndrome, 1) - np.uint64(1)), np.uint64(0))
    return part ^ flip


def masks(bits: int, reach: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for k in range(reach + 1) for c in combinations(range(bits), k)], np.uint64)


def anchor_rows(fps: DataFrame, threshold: int, blocks: int) -> DataFrame:
    """(anchor, fp, home) for each distinct fingerprint: its home in every block and the anchors it visits.

    The anchor's number holds the block above the block's bits, so blocks do not mix. Further columns of `fps` (longs) go
    along.
    """
    reach = threshold // blocks
    bounds = block_bounds(blocks)
    more = [c for c in fps.columns if c != "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                fp = b.column(0).slice(i, 2000).to_numpy(zero_copy_only=False).astype(np.int64)
                every, out = np.arange(len(fp)), []
                for k, (first, bits) in enumerate(bounds):
                    part = fp.view(np.uint64) >> np.uint64(first) & np.uint64((1 << bits) - 1)
                    near = np.sort(homes(part[:, None] ^ masks(bits, reach)[None, :], bits), axis=1)
                    new = np.c_[np.ones(len(near), bool), near[:, 1:] != near[:, :-1]]
                    row, col = np.nonzero(new)
                    tag = np.uint64(k << 48)
                    out.append((homes(part, bits) | tag, every, np.ones(len(fp), bool)))
                    out.append((near[row, col] | tag, row, np.zeros(len(row), bool)))
                anchor, owner, home = (np.concatenate(c) for c in zip(*out, strict=True))
                along = [b.column(n + 1).slice(i, 2000).take(pa.array(owner)) for n in range(len(more))]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[owner]), pa.array(home), *along], ["anchor", "fp", "home", *more])

    return fps.select("fp", *more).mapInArrow(run, ", ".join(["anchor long, fp long, home boolean", *[f"{c} long" for c in more]]))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest linked node of each of n nodes, given links a - b, by hooking and halving."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        left = root[a] != root[b]
        a, b = a[left], b[left]
    return root


def cell_links(living: np.ndarray, visiting: np.ndarray, threshold: int, at_once: int = 1 << 20, check: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (node, smallest linked node), of the links between a cell's homes and visitors.

    Both are rows with a field fp. With `check` they have node, c1 and c2 too, and those halves of a link's signatures
    differ in at most `check` bits.
    """
    name = "fp" if check is None else "node"
    nodes, where = np.unique(np.r_[living[name], visiting[name]], return_inverse=True)
    place, guest = where[: len(living)], where[len(living) :]
    x, y = living["fp"].astype(np.int64).view(np.uint64), visiting["fp"].astype(np.int64).view(np.uint64)
    root = np.arange(len(nodes))
    step = max(1, at_once // max(len(x), 1))
    for i in range(0, len(y), step):
        near = np.bitwise_count(y[i : i + step, None] ^ x[None, :]) <= threshold
        g, p = np.nonzero(near)
        if check is not None:
            apart = sum(np.bitwise_count(visiting[c][i + g] ^ living[c][p]).astype(np.int64) for c in ("c1", "c2"))
            g, p = g[apart <= check], p[apart <= check]
        a, b = root[guest[i : i + step][g]], root[place[p]]
        root = forest(a[a != b], b[a != b], len(nodes))[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def links(rows: DataFrame, threshold: int, most: int = 4096, check: int | None = None) -> DataFrame:
    """(u, v) links that connect all fingerprints of `rows` within `threshold` bits of each other (see cell_links for `check`).

    A cell with more than `most` homes is cut into slices by hash; its visitors go to every slice, so all
    of its pairs are still compared, in several tasks.
    """
    crowded = durable(rows.where("home").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > most))
    n = crowded.count()
    if n:
        slim = F.broadcast(crowded) if n <= 100_000 else crowded
        slices = F.coalesce(F.ceil(F.col("n") / most).cast("int"), F.lit(1))
        own = F.pmod(F.xxhash64("fp"), slices).cast("int")
        rows = rows.join(slim, "anchor", "left").select(
            *rows.columns, F.explode(F.when(F.col("home"), F.array(own)).otherwise(F.sequence(F.lit(0), slices - 1))).alias("slice")
        )
    else:
        rows = rows.withColumn("slice", F.lit(0))
    dealt = rows.repartition("anchor", "slice").sortWithinPartitions("anchor", "slice", "home")
    fields = [("anchor", "i8"), ("slice", "i4"), ("fp", "i8"), ("home", "?"), *([] if check is None else [("node", "i8"), ("c1", "u8"), ("c2", "u8")])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def cells(t: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                split = i + int(np.searchsorted(t["home"][i:j], True))
                if i < split < j and j - i > 2:  # two rows: one fingerprint at home, that visits itself
                    found.append(cell_links(t[split:j], t[i:split], threshold, check=check))
            if found := [f for f in found if len(f[0])]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["u", "v"])

        for b in batches:
            t = np.zeros(b.num_rows, fields)
            for name in t.dtype.names:
                column = b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
                t[name] = column.view(np.uint64) if name in ("c1", "c2") else column
            t = t if held is None else np.concatenate([held, t])
            new = np.flatnonzero((t["anchor"][1:] != t["anchor"][:-1]) | (t["slice"][1:] != t["slice"][:-1])) + 1
            if len(new):
                yield from cells(t, np.r_[0, new])
                t = t[new[-1] :]
            held = t
        if held is not None and len(held):
            yield from cells(held, np.array([0, len(held)]))

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, threshold: int = 4, blocks: int = 3, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable over links), text_hash
    (XXH64 of the text) and root (the component's number: its smallest fingerprint, as a signed long).

    One row per input row. Null, empty and blank texts have fingerprint zero and link like any other;
    repeated ids keep a row each; rows with a null id belong to their component but give it no id (null if
    no row has one). An empty table gives no rows. Columns besides doc_id and text are ignored. `blocks`
    sets the number of anchors: 3 suits up to about 10**8 different fingerprints, 2 (2**27 anchors a block,
    343 copies of each fingerprint) larger sets; the result is the same. A fingerprint that very many rows
    have is joined back by broadcast (see join_by_key), so its rows do not meet in one task.
    """
    marked = durable(fingerprints(docs, shingle, seed))
    distinct = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    joined = connected_components(links(anchor_rows(distinct, threshold, blocks), threshold)).withColumnRenamed("node", "fp")
    linked = distinct.join(joined, "fp")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    of = join_by_key(linked.select("fp", "root"), smallest, "root", "size", distinct.count()).select("fp", "root", "component_id")
    of = durable(distinct.join(of, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id")))
    rows = of.agg(F.sum("n")).first()[0] or 0
    named = join_by_key(marked, of, "fp", "n", rows)
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "root")


def near_copies(docs: DataFrame, threshold: int = 5, shingle: int = 1, blocks: int = 3, check_shingle: int = 5, check: int = 20) -> DataFrame:
    """doc_id, text_hash and root (the number of the row's group, a signed long) of every row: copies by shingles of
    `check_shingle` words.

    SimHash fingerprints of `shingle` words (single words move little when a text is edited) are linked by anchors as in
    near_duplicates, and a link counts if signatures of `check_shingle` words differ in at most `check` of 128 bits: texts
    that share 0.8 of their shingles differ in 13 on average and in more than 20 once in fifty, texts that share half
    in 32. Rows with equal fingerprints and signatures are one group from the start. Null, empty and blank texts are one
    group; rows with repeated or null ids are told apart by their text_hash. An empty table gives no rows.
    """
    marked = durable(checked_fingerprints(docs, shingle, check_shingle))
    distinct = durable(marked.groupBy("node", "fp", "c1", "c2").agg(F.count("*").alias("n")))
    roots = connected_components(links(anchor_rows(distinct.select("fp", "node", "c1", "c2"), threshold, blocks), threshold, check=check))
    of = durable(distinct.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root")))
    rows = of.agg(F.sum("n")).first()[0] or 0
    return join_by_key(marked.select("doc_id", "text_hash", "node"), of, "node", "n", rows).select("doc_id", "text_hash", "root")
