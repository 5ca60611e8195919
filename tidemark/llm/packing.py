"""Packing documents into fixed token windows by the sum-of-squares rule.

Every task packs the documents of its own input split in one pass: full windows are cut off long
documents, and what is left of each goes, online, to the fill level that makes the sum of squared
counts of partly filled windows smallest. The counts live in one array indexed by level. At the end of
a split the fullest open windows are topped up from the emptiest ones, and the last one is cut into
sequences whose lengths are powers of two, so nothing is padded.

There is no shuffle and no state beyond a split, so a lost task is simply run again.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A piece: doc_id, tokens of its document before it, tokens of its document, its ids as little-endian 32-bit bytes.
Piece = tuple[int | None, int, int, bytes]

COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{c} long" for c in COLUMNS)


#: Words of these letters, which no normalisation but lower-casing changes, with these marks after them.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?$%&*#|]*)")
MARKS = b".,;:!?$%&*#|"


def byte_symbols() -> dict[int, str]:
    """The letters that stand for the 256 bytes in byte-level vocabularies: visible Latin-1 characters
    for themselves, the other bytes, in order, for the characters from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokenizer:
    """Token ids of a text as little-endian 32-bit bytes, word by word with a bounded memory of words.

    For a vocabulary that lower-cases and drops white space, a text's ids are those of its words in
    order, so each distinct word is encoded once; a plain word goes straight to the vocabulary's merges,
    any other through the whole tokenizer. Words longer than `longest` bytes are encoded but not kept;
    the memory is emptied at `most` words.
    """

    def __init__(self, path: str, most: int = 1_000_000, longest: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.model, self.symbols = self.encoder.model, byte_symbols()
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {b"": b""}
        self.most, self.longest = most, longest

    def part(self, raw: bytes) -> bytes:
        found = self.parts.get(raw)
        if found is None:
            text = raw.decode() if raw.isascii() else raw.decode("latin-1").translate(self.symbols)
            found = self.parts[raw] = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
        return found

    def word(self, raw: bytes) -> bytes:
        core = raw.rstrip(MARKS)
        if core.isalpha() and len(raw) <= self.longest:
            return self.part(core.lower()) + self.part(raw[len(core) :])
        text = raw.decode("utf-8", "replace")
        if len(raw) <= self.longest and (plain := PLAIN.fullmatch(text)):
            return self.part(plain[1].lower().encode()) + self.part(plain[2].encode())
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        words = text.encode("utf-8", "replace").split()
        known, long = self.known, None
        for w in set(words):
            if w not in known:
                if len(w) <= self.longest:
                    known[w] = self.word(w)
                else:
                    long = {w: self.word(w)} | (long or {})
        out = b"".join([long[w] if w in long else known[w] for w in words]) if long else b"".join(map(known.__getitem__, words))
        if len(known) > self.most:
            known.clear()
            self.parts = {b"": b""}
        return out


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, so that its memory outlives a task."""
    return WordTokenizer(path)


class SquaresPacker:
    """Sum-of-squares packing into windows of `size` tokens; `take` and `finish` return finished sequences as lists of pieces."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def take(self, doc_id: int | None, ids: bytes) -> list[list[Piece]]:
        total = len(ids) // 4
        whole = total - total % self.size
        done = [[(doc_id, i, total, ids[4 * i : 4 * (i + self.size)])] for i in range(0, whole, self.size)]
        if whole < total:
            piece = (doc_id, whole, total, ids[4 * whole :])
            level = self.best_level(total - whole)
            window = [piece]
            if level:
                window = self.open[level].pop() + window
                self.counts[level] -= 1
            level += total - whole
            if level == self.size:
                done.append(window)
            else:
                self.open.setdefault(level, []).append(window)
                self.counts[level] += 1
        return done

    def best_level(self, tokens: int) -> int:
        """The level (0: a new window) to put `tokens` on; the fullest of equally good ones."""
        n, reach = self.counts, self.size - tokens
        cost = 2 * (n[tokens:] - n[: reach + 1]) + 2
        cost[0] -= 1  # a new window leaves no level
        cost[reach] -= 1  # a full window joins no level
        usable = n[: reach + 1] > 0
        usable[0] = True
        cost[~usable] = np.iinfo(np.int64).max
        return reach - int(np.argmin(cost[::-1]))

    def finish(self) -> list[list[Piece]]:
        """Tops up the fullest open windows from the emptiest, and cuts the last one at powers of two."""
        windows = [(level, w) for level, group in sorted(self.open.items(), reverse=True) for w in group]
        self.open, self.counts[:] = {}, 0
        done: list[list[Piece]] = []
        i, j = 0, len(windows) - 1
        while i < j:
            level, window = windows[i]
            while level < self.size and i < j:
                low, donor = windows[j]
                moved, rest = cut(donor, min(self.size - level, low))
                window, level, low = window + moved, level + min(self.size - level, low), sum(len(p[3]) for p in rest) // 4
                windows[j] = (low, rest)
                if not low:
                    j -= 1
            windows[i] = (level, window)
            if level == self.size:
                done.append(window)
                i += 1
        for level, window in windows[i : j + 1]:
            for bit in range(level.bit_length() - 1, -1, -1):
                if level >> bit & 1:
                    part, window = cut(window, 1 << bit)
                    done.append(part)
        return done


def cut(window: list[Piece], tokens: int) -> tuple[list[Piece], list[Piece]]:
    """The first `tokens` tokens of a window and the rest, splitting a piece where needed."""
    head, tail = [], []
    for doc_id, start, total, ids in window:
        n = min(tokens, len(ids) // 4)
        tokens -= n
        if n:
            head.append((doc_id, start, total, ids[: 4 * n]))
        if 4 * n < len(ids):
            tail.append((doc_id, start + n, total, ids[4 * n :]))
    return head, tail


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and `ids`, if asked for).

    A document's ids are its text's, by the tokenizer file at `tokenizer_path` (which must drop white
    space), followed by `end_id`. A null or empty text has `end_id` alone. Repeated rows, and rows with a
    repeated or null id, are packed like any other. An empty table gives no rows. Columns besides doc_id
    and text are ignored. Each id of each row is in exactly one piece, offsets in a sequence have no gap.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("_split"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, end, sequence = word_tokenizer(tokenizer_path), SquaresPacker(window), np.array([end_id], "<u4").tobytes(), 0

        def table(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence
            out, ids = [], []
            for pieces in sequences:
                offset = 0
                for doc_id, start, total, raw in pieces:
                    out.append((doc_id, start, len(raw) // 4, zlib.crc32(raw), total, sequence, offset))
                    offset += len(raw) // 4
                    if with_ids:
                        ids.append(np.frombuffer(raw, "<u4"))
                sequence += 1
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * len(COLUMNS)
            return pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int64()))] if with_ids else []), COLUMNS + ["ids"] * with_ids)

        for b in batches:
            if b.num_rows and not sequence:
                sequence = b.column(2)[0].as_py() << 33
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                done = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    done += packer.take(doc_id, words.encode(text or "") + end)
                if done:
                    yield table(done)
        if done := packer.finish():
            yield table(done)

    return rows.mapInArrow(run, SCHEMA + ", ids array<long>" * with_ids)
