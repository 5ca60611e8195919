"""Removing word passages that repeat across documents, by level-wise doubling.

The first level looks at windows of a part of the wanted length, the next at twice that length, and so on
up to `window` words. At each level a window is a candidate only where the shorter windows in it repeat
across documents; when none does, the search is over. Levels below the last are sampled by content: of the
short windows inside a full window only the one with the smallest hash counts, which is the same one
wherever the passage stands, so no repeat is missed and few short windows travel.

Hashes are polynomial prefix sums over words, so every window of every level costs a few array operations
a word. The last level compares 96 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTE_BASE, WORD_BASES = 0x5851F42D4C957F2D, (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as was asked for."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """Hashes of all windows of a text's words."""

    byte_powers = Powers(BYTE_BASE)
    word_powers = tuple(Powers(b) for b in WORD_BASES)

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        if not words:
            return
        raw = np.frombuffer(b" ".join(words), np.uint8)
        ends = np.r_[np.flatnonzero(raw == 32), len(raw)]
        starts = np.r_[0, ends[:-1] + 1]
        up, down = self.byte_powers.to(len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        word = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        self.sums = []
        for powers in self.word_powers:
            up, down = powers.to(self.n)
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum(word * up, out=total[1:])
            self.sums.append((total, down))

    def hashes(self, length: int, which: int = 0) -> np.ndarray:
        """One for each window of `length` words, in order."""
        if self.n < length:
            return np.zeros(0, np.uint64)
        total, down = self.sums[which]
        return mix((total[length:] - total[:-length]) * down[: self.n - length + 1])

    def signature(self, length: int, window: int) -> np.ndarray:
        """For each full window the smallest hash of its windows of `length` words."""
        return sliding_min(self.hashes(length), window - length + 1) if self.n >= window else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, done = x, 1
    while 2 * done <= width:
        out, done = np.minimum(out[:-done], out[done:]), 2 * done
    rest = width - done
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def levels(window: int, first: int) -> list[int]:
    """first, twice that, ... below `window`, and `window`."""
    out = []
    while first < window:
        out.append(first)
        first *= 2
    return [*out, window]


def ascii_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, as UTF-8."""
    return (text or "").encode("utf-8", "replace").split()


def candidates(docs: DataFrame, alive: DataFrame | None, lower: int | None, length: int, window: int, part: str = "shared") -> DataFrame:
    """(k1, k2, id): each document's distinct keys of one level, where the level below is in `part` of `alive` (if there is one).

    Below the last level a key is a sampled short window's hash (k2 is 0), at the last 96 bits of a full window's.
    """
    rows = docs if alive is None else docs.join(alive, "id", "left").select("id", "text", F.col(part).alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, out = b.schema.names, []
            ids, texts = b.column(names.index("id")), b.column(names.index("text"))
            keys = b.column(names.index("keys")) if lower else None
            for i in range(b.num_rows):
                if not ids[i].is_valid or keys is not None and not keys[i].is_valid:
                    continue
                w = Windows(ascii_words(texts[i].as_py()))
                if w.n < window:
                    continue
                k1 = w.hashes(window) if length == window else w.signature(length, window)
                k2 = w.hashes(window, 1) if length == window else np.zeros(len(k1), np.uint64)
                k2 = (k2 >> np.uint64(32)).astype(np.uint32)
                if lower:
                    stay = np.isin(w.signature(lower, window), keys[i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                    k1, k2 = k1[stay], k2[stay]
                k1, first = np.unique(k1, return_index=True)
                if len(k1):
                    out.append((k1.view(np.int64), k2[first].view(np.int32), np.full(len(k1), ids[i].as_py(), np.int64)))
                if sum(len(x[0]) for x in out[-64:]) > 200_000 or len(out) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["k1", "k2", "id"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["k1", "k2", "id"])

    return rows.mapInArrow(run, "k1 long, k2 int, id long")


def repeated(every: DataFrame, later: DataFrame) -> DataFrame:
    """(id, shared, copied): which of its keys in `later` another document has too, and which one of smaller id.

    `every` has all documents' keys. Ends are pre-aggregated and joined back, so a passage that stands in a
    large share of the documents is not gathered in one place.
    """
    ends = every.groupBy("k1", "k2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    found = later.join(ends, ["k1", "k2"])
    return found.groupBy("id").agg(F.collect_list("k1").alias("shared"), F.collect_list(F.when(F.col("low") < F.col("id"), F.col("k1"))).alias("copied"))


def remove_repeats(docs: DataFrame, window: int = 50, first: int = 25) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, spans of every row.

    A word goes if a window of `window` words around it also starts in a document with a smaller doc_id;
    windows are those of the input. `kept_text` has the other words, joined by one space; `spans` are the
    removed runs of words as (start, end), end excluded. Null, empty and short texts keep all their words.
    Rows with the same id are no copies of each other, and each is cleaned; rows with a null id are kept
    whole and take nothing from others. An empty table gives no rows; columns besides doc_id and text are
    ignored. Longer repeats need no further level: windows of `window` words cover them.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    steps = levels(window, first)
    alive, lower = None, None
    for length in steps:
        every = candidates(own, alive, lower, length, window)
        # a full window that repeats one of a smaller id has short windows that do
        later = candidates(own, alive, lower, length, window, "copied") if length == window else every
        alive = repeated(every, later)
        lower = length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_removed", "kept_text", "spans"]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            at = [b.schema.get_field_index(c) for c in ("id", "text", "keys")]
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                ids, texts, keys = (part.column(k) for k in at)
                n, gone, kept, spans = [], [], [], []
                for k in range(part.num_rows):
                    words = ascii_words(texts[k].as_py())
                    n.append(len(words))
                    runs = []
                    if keys[k].is_valid:
                        starts = np.isin(Windows(words).hashes(window), keys[k].values.to_numpy(zero_copy_only=False).view(np.uint64))
                        step = np.zeros(len(words) + 1, np.int64)
                        step[: len(starts)] += starts
                        step[window : window + len(starts)] -= starts
                        out = np.cumsum(step[:-1]) > 0
                        edges = np.flatnonzero(np.diff(np.r_[False, out, False].astype(np.int8)))
                        runs = [{"start": int(a), "end": int(z)} for a, z in zip(edges[::2], edges[1::2], strict=True)]
                        words = list(compress(words, ~out))
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8"))
                    spans.append(runs)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)], names)

    return own.join(alive, "id", "left").select("id", "text", F.col("copied").alias("keys")).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start: int, end: int>>")
