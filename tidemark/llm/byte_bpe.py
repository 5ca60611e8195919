"""Byte-level BPE: texts to token ids and back, as a rank file says.

Encoding has two tiers. A text is cut into pre-tokens by the vocabulary's pattern. A minimal perfect hash over the
vocabulary, asked for all distinct pre-tokens of a slice of rows at once, finds those that are tokens as they stand. The
others are merged: their bytes are a linked list, and a heap of the neighbouring pairs that are tokens gives the pair of
lowest rank (of equal ones the leftmost) until no pair is left. Decoding joins the bytes of the ids.

Everything happens inside a row, so there is no shuffle and a lost task is simply run again. A task holds the vocabulary,
the pre-tokens of one slice and a bounded memory of merged pre-tokens; a very long text goes through in parts.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .substring_dedup import mix

#: Odd multipliers of the polynomial hash of a key's bytes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """One 64-bit hash a key: a polynomial of its bytes, by lengths, so that each step works on many keys at once."""
    out = np.zeros(len(keys), np.uint64)
    if not keys:
        return out
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    order = np.argsort(lengths, kind="stable")
    raw = np.frombuffer(b"".join([keys[i] for i in order]), np.uint8)
    ends = np.cumsum(lengths[order])
    starts = ends - lengths[order]
    firsts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for a, z in zip(firsts, [*firsts[1:], len(keys)], strict=True):
        n = int(lengths[order[a]])
        state = np.full(z - a, n + 1, np.uint64)
        if n <= 64:
            for k in range(n):
                state = state * np.uint64(BASES[0]) + raw[starts[a:z] + k] + np.uint64(1)
        else:  # few keys are long: each one's bytes at once
            powers = np.cumprod(np.full(n, BASES[0], np.uint64), dtype=np.uint64)
            for i in range(a, z):
                state[i - a] += ((raw[starts[i] : ends[i]] + np.uint64(1)) * powers).sum(dtype=np.uint64)
        out[order[a:z]] = mix(state)
    return out


class PerfectHash:
    """A minimal perfect hash: the distinct `keys` get the slots 0 to len(keys) - 1, each its own.

    Level by level every key left over is hashed into a bit array; a bit that one key alone hits is set and settles it.
    A key's slot is the number of set bits before its own. Keys that share a 64-bit hash would never part, so those raise.
    """

    def __init__(self, keys: list[bytes], bits_a_key: float = 1.6):
        left = key_hashes(keys)
        if len(np.unique(left)) < len(left):
            raise ValueError("keys are repeated, or two of them share a hash")
        self.levels: list[tuple[int, np.ndarray]] = []
        while len(left):
            size = max(64, int(bits_a_key * len(left)))
            at = self.place(left, len(self.levels), size)
            self.levels.append((size, np.bincount(at, minlength=size) == 1))
            left = left[~self.levels[-1][1][at]]
        self.before = [np.cumsum(bits) - bits for _, bits in self.levels]
        sums = np.cumsum([0] + [int(bits.sum()) for _, bits in self.levels])
        self.before = [b + s for b, s in zip(self.before, sums[:-1], strict=True)]
        self.keys: list[bytes] = [b""] * len(keys)
        for key, slot in zip(keys, self.slots(keys).tolist(), strict=True):
            self.keys[slot] = key

    @staticmethod
    def place(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        step = np.uint64((BASES[1] * (2 * level + 1)) & 0xFFFFFFFFFFFFFFFF)
        return (mix(hashes * np.uint64(BASES[0]) + step) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """A slot for every key; one that is not in the table gets any slot, or -1."""
        hashes = key_hashes(keys)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, bits) in enumerate(self.levels):
            at = self.place(hashes[open_], level, size)
            hit = bits[at]
            out[open_[hit]] = self.before[level][at[hit]]
            open_ = open_[~hit]
        return out

    def find(self, keys: list[bytes]) -> list[int]:
        """The slot of each key that is in the table, -1 for the others; keys are compared in full."""
        own = self.keys
        return [s if s >= 0 and own[s] == k else -1 for k, s in zip(keys, self.slots(keys).tolist(), strict=True)]


class ByteBpe:
    """The vocabulary of a rank file (base64 token and rank a line); every single byte must be a token."""

    def __init__(self, path: str, pattern: str, most: int = 500_000, longest: int = 64):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing}")
        self.pattern = regex.compile(pattern)
        self.table = PerfectHash(list(ranks))
        self.ids = [np.array([ranks[k]], "<u4").tobytes() for k in self.table.keys]  # by slot
        self.bytes = {i: k for k, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        # what two neighbouring tokens make: the token of their joint bytes
        self.pairs = {(ranks[k[:i]] << 32) | ranks[k[i:]]: r for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks}
        self.first = {(a, b): r for a in range(256) for b in range(256) if (r := self.pairs.get(self.single[a] << 32 | self.single[b])) is not None}
        self.merged: dict[str, bytes] = {}
        self.most, self.longest = most, longest

    def merge(self, raw: bytes) -> bytes:
        """Ids of a pre-token by merging its bytes."""
        pair, n, single = self.pairs.get, len(raw), self.single
        ids = [single[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = list(map(self.first.get, zip(raw, raw[1:])))  # what each place makes with the next one
        now.append(None)
        heap = [r << 32 | i for i, r in enumerate(now) if r is not None]  # ordered by rank, then place
        heapify(heap)
        while heap:
            i = heappop(heap)
            rank = i >> 32
            i &= 0xFFFFFFFF
            if now[i] != rank:
                continue  # one of the two has been merged since
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], now[j] = rank, -1, None
            if k < n:
                before[k] = i
                r = now[i] = pair(rank << 32 | ids[k])
                if r is not None:
                    heappush(heap, r << 32 | i)
            else:
                now[i] = None
            if i:
                h = before[i]
                r = now[h] = pair(ids[h] << 32 | rank)
                if r is not None:
                    heappush(heap, r << 32 | h)
        out = array("I", [x for x in ids if x >= 0])
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def resolve(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens: the hash first, the heap for what it does not hold."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        out = {}
        for piece, key, slot in zip(pieces, raw, self.table.find(raw), strict=True):
            if slot >= 0:
                out[piece] = self.ids[slot]
            elif (found := self.merged.get(piece)) is not None:
                out[piece] = found
            else:
                found = out[piece] = self.merge(key)
                if len(key) <= self.longest:
                    if len(self.merged) >= self.most:
                        self.merged.clear()
                    self.merged[piece] = found
        return out

    def encode(self, texts: list[str], part: int = 1_000_000) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        cut = [self.pattern.findall(t) if len(t) <= part else None for t in texts]
        known = self.resolve(list({p: None for pieces in cut if pieces for p in pieces}))
        for i, (text, pieces) in enumerate(zip(texts, cut, strict=True)):
            if pieces is not None:
                out[i] = b"".join(map(known.__getitem__, pieces))
            else:
                matches, joined = (m.group() for m in self.pattern.finditer(text)), bytearray()
                while some := list(islice(matches, part // 4)):
                    own = self.resolve(list(dict.fromkeys(some)))
                    joined += b"".join(map(own.__getitem__, some))
                out[i] = bytes(joined)
        return out

    def decode(self, ids: bytes, part: int = 1_000_000) -> bytes:
        """The bytes of ids given as little-endian unsigned 32-bit integers; an id without a token raises."""
        every = np.frombuffer(ids, "<u4")
        return b"".join([b"".join(map(self.bytes.__getitem__, every[i : i + part].tolist())) for i in range(0, len(every), part)])


@lru_cache(maxsize=1)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One for each Python worker, so that it outlives a task."""
    return ByteBpe(path, pattern)


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 8_000_000, most_rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most `most_rows` rows and about `most_bytes` bytes in `column` (one row at least)."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > most_bytes or i - start >= most_rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def encode_bytes(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of every row, by the rank file at `path`.

    `path` is read where the tasks run, as the tokenizer files are part of the installation. Null and empty texts have
    no ids. Rows with a repeated or null id, and repeated rows, are encoded like any other. An empty table gives no rows.
    Columns besides doc_id and text are left out. No text is cut and no special token is known: all of it is ordinary.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for b in batches:
            for part in slices(b, 1):
                ids = bpe.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode_bytes(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """`encoded` (doc_id, ids) with the bytes of its ids in `decoded`; null ids count as none, further columns are left out."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for b in batches:
            for part in slices(b, 1):
                texts = [bpe.decode(i or b"") for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, "doc_id long, ids binary, decoded binary")
