"""Periodic runs of words, found on a grammar-compressed text.

A run is a stretch of words with smallest period q (words q apart are equal) of length `least` and `times` periods or
more that no neighbouring word extends. The steps for each text:

1. Every word of a run lies in a passage of `grain` words that stands elsewhere in the text too (hashes of windows tell;
   a clash only keeps a word too many). Only stretches of such words go on, as word ids. Plain prose ends here.
2. Re-Pair: the most frequent pair of neighbouring symbols, of equally frequent ones the oldest, gets a new symbol, until
   no pair occurs twice. What is left at the top is joined by a balanced tree. Each symbol stands for one text, however
   often it occurs.
3. In each symbol's text the stretches of period q that cross the seam of its two halves are found once: q is the
   distance from the seam to a copy of the word beside it, and the extent is a longest common extension to both sides.
4. The stretches are carried to all places of the symbol; those of one period that overlap are one, and of the periods of
   one stretch the smallest counts.

Everything happens inside a row, so there is no shuffle and a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import slices
from .substring_dedup import Powers, Windows, ascii_words, mix

POWERS = Powers(0xA0761D6478BD642F)


def repeated_stretches(words: list[bytes], least: int, times: int) -> list[tuple[int, int]]:
    """(start, end) of stretches that hold all runs: words covered by a passage that stands twice in the text."""
    grain = least - least // times  # a run and its copy one period on share this much
    h = Windows(words).hashes(grain)
    if not len(h):
        return []
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    step[: len(h)] += twice
    step[grain : grain + len(h)] -= twice
    inside = np.cumsum(step[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    return [(int(a), int(z)) for a, z in zip(edges[::2], edges[1::2], strict=True) if z - a >= least]


class Grammar:
    """A Re-Pair grammar of `text` (ids from 0): rules[k] are the two symbols of symbol `letters` + k, `top` what is left.

    Symbols are linked, and each pair has the set of its places. Pairs wait in one queue for each frequency. A pair whose
    frequency has changed waits anew; entries that are out of date are passed over.
    """

    def __init__(self, text: list[int]):
        self.letters = max(text, default=-1) + 1
        self.rules: list[tuple[int, int]] = []
        n = len(text)
        sym, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[tuple[int, int], dict[int, None]] = {}
        i = 0
        while i < n - 1:
            pair = (sym[i], sym[i + 1])
            places.setdefault(pair, {})[i] = None
            # of three or more equal symbols every second pair counts, as pairs do not overlap
            i += 2 if i + 2 < n and sym[i] == sym[i + 1] == sym[i + 2] else 1
        queues: dict[int, deque] = {}
        for pair, at in places.items():
            if len(at) > 1:
                queues.setdefault(len(at), deque()).append(pair)
        most = max(queues, default=1)

        def drop(i: int, j: int) -> None:
            at = places.get((sym[i], sym[j]))
            if at is not None and at.pop(i, 0) is None:
                if len(at) > 1:
                    queues.setdefault(len(at), deque()).append((sym[i], sym[j]))
                elif not at:
                    del places[(sym[i], sym[j])]

        def add(i: int, j: int, fresh: dict) -> None:
            pair = (sym[i], sym[j])
            at = places.setdefault(pair, {})
            if sym[i] == sym[j] and (before[i] in at and sym[before[i]] == sym[i] or j in at):
                return  # it would overlap one that counts
            at[i] = None
            fresh[pair] = None

        while most > 1:
            queue = queues.get(most)
            if not queue:
                most -= 1
                continue
            pair = queue.popleft()
            if len(places.get(pair, ())) != most:
                continue
            new = self.letters + len(self.rules)
            self.rules.append(pair)
            at, fresh = sorted(places.pop(pair)), {}
            for i in at:
                j = after[i]
                if j >= n or sym[i] != pair[0] or sym[j] != pair[1]:
                    continue
                h, k = before[i], after[j]
                if h >= 0:
                    drop(h, i)
                if k < n:
                    drop(j, k)
                sym[i], sym[j] = new, -1
                after[i] = k
                if k < n:
                    before[k] = i
                    add(i, k, fresh)
                if h >= 0:
                    add(h, i, fresh)
            for p in fresh:
                count = len(places.get(p, ()))
                if count > 1:
                    queues.setdefault(count, deque()).append(p)
                    most = max(most, count)
        self.top = [x for x in sym if x >= 0]
        self.repeats = len(self.rules)
        row = self.top
        while len(row) > 1:
            joined = []
            for a, b in zip(row[::2], row[1::2]):
                joined.append(self.letters + len(self.rules))
                self.rules.append((a, b))
            row = joined + row[len(joined) * 2 :]
        self.root = row[0] if row else None

    def lengths(self) -> list[int]:
        out = [1] * self.letters
        for a, b in self.rules:
            out.append(out[a] + out[b])
        return out

    def places(self, lengths: list[int], least: int) -> list[np.ndarray | None]:
        """Where each symbol of `least` words or more stands in the text, by walking the rules from the root."""
        out: list[list] = [[] for _ in lengths]
        if self.root is not None:
            out[self.root].append(np.zeros(1, np.int64))
        done: list[np.ndarray | None] = [None] * len(lengths)
        for s in range(len(lengths) - 1, self.letters - 1, -1):
            if lengths[s] < least or not out[s]:
                continue
            at = done[s] = np.concatenate(out[s])
            out[s] = []
            a, b = self.rules[s - self.letters]
            if lengths[a] >= least:
                out[a].append(at)
            if lengths[b] >= least:
                out[b].append(at + lengths[a])
        return done


def common_extension(sums: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many equal words follow from `a` and `b` (or stand before them, if `back`), up to `most`; by halving."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) // 2
        x, y = (a - mid, b - mid) if back else (a, b)
        same = (sums[x + mid] - sums[x]) * down[x] == (sums[y + mid] - sums[y]) * down[y]
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)


def crossing(text: np.ndarray, sums: np.ndarray, down: np.ndarray, start: int, seam: int, end: int, least: int, times: int) -> np.ndarray:
    """(start, end, period) of stretches in text[start:end] that cross `seam`, with the least length and `times` periods.

    Half of such a stretch or more lies on one side of the seam, so with three periods more than one does: the word beside
    the seam comes again one period on, on that side.
    """
    found = []
    longest = (end - start) // times
    for right in (True, False):
        if right:
            q = np.flatnonzero(text[seam + 1 : min(end, seam + longest + 1)] == text[seam]) + 1
            near, far = np.full(len(q), seam, np.int64), seam + q
        else:
            q = np.flatnonzero(text[max(start, seam - 1 - longest) : seam - 1][::-1] == text[seam - 1]) + 1
            near, far = seam - q, np.full(len(q), seam, np.int64)
        if not len(q):
            continue
        # the stretch is what agrees with its copy one period on: positions [near - l, near + r) and one period more
        r = common_extension(sums, down, near, far, end - far, False)
        left = common_extension(sums, down, near, far, near - start, True)
        size = left + r + q
        ok = (size >= np.maximum(least, times * q)) & (near - left < seam) & (far + r > seam)
        found.append(np.stack([(near - left)[ok], (far + r)[ok], q[ok]], 1))
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found)
    if len(rows) < 2:
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.r_[True, (np.diff(rows[:, :2], axis=0) != 0).any(1)]]


def maximal(rows: np.ndarray) -> np.ndarray:
    """Joins stretches of one period that overlap by a period or more, then keeps the smallest period of each stretch."""
    if len(rows) < 2:
        return rows
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0], rows[:, 2]))]
    out: list[list[int]] = []
    for s, e, q in rows.tolist():
        if out and out[-1][2] == q and s + q <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, q])
    rows = np.array(out, np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.r_[True, (np.diff(rows[:, :2], axis=0) != 0).any(1)]]


def runs_of_ids(ids: list[int], least: int = 24, times: int = 3) -> np.ndarray:
    """(start, end, period) of all runs of a sequence of ids from 0, by start, then period."""
    n = len(ids)
    if n < least:
        return np.zeros((0, 3), np.int64)
    grammar = Grammar(ids)
    lengths = grammar.lengths()
    places = grammar.places(lengths, least)
    text = np.array(ids, np.int64)
    up, down = POWERS.to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(text.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    found = []
    for s in range(grammar.letters, len(lengths)):
        at = places[s]
        if at is None:
            continue
        one = int(at[0])  # any place shows the symbol's text
        rows = crossing(text, sums, down, one, one + lengths[grammar.rules[s - grammar.letters][0]], one + lengths[s], least, times)
        if len(rows):
            rows[:, :2] -= one
            moved = np.repeat(rows[None], len(at), 0)
            moved[:, :, :2] += at[:, None, None]
            found.append(moved.reshape(-1, 3))
    return maximal(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)


def find_runs(words: list[bytes], least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start, then period."""
    out = []
    for a, z in repeated_stretches(words, least, times):
        number: dict[bytes, int] = {}
        ids = [number.setdefault(w, len(number)) for w in words[a:z]]
        out += [(a + s, e - s, q) for s, e, q in runs_of_ids(ids, least, times).tolist()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    gone = np.cumsum(step[:-1]) > 0
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def detect_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, n_runs, runs, start, length, period, exponent_milli, runs_sha256, collapsed (text) of every row.

    `runs` has every run as (start, length, period), by start, then period; `start` to `exponent_milli` describe the one
    with the greatest length / period, of equal ones that with the smallest start, then period, and are null without a
    run. `runs_sha256` hashes every run's `start,length,period` and a line feed. `collapsed` keeps of each run the first
    period. Null, empty and short texts have no run. Rows with a repeated or null id, and repeated rows, are treated
    alike, each by its own text. An empty table gives no rows; columns besides doc_id and text are left out. `times` must
    be 3 or more: below that a stretch may hold no more than one period on both sides of a seam.
    """
    if times < 3 or least < times:
        raise ValueError("runs need three periods or more, and at least a word each")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "n_runs", "runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed"]
    kinds = [pa.int64(), pa.int64(), pa.list_(RUN), *[pa.int64()] * 4, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                out = []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = ascii_words(text)
                    runs = find_runs(words, least, times) if len(words) >= least else []
                    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
                    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                    out.append(
                        (i, len(runs), [{"start": s, "length": n, "period": q} for s, n, q in runs], *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines).hexdigest(), collapsed(words, runs).decode("utf-8", "replace"))
                    )
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(
        run, "doc_id long, n_runs long, runs array<struct<start: long, length: long, period: long>>, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed string"
    )


def with_planted_tail(doc_id: Column, text: Column) -> Column:
    """The texts of one row in ten with a periodic end, by the crc32 of the id: from word a on, p words over and over."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        block = F.slice(words, a + 1, p)
        tail = F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")).otherwise(F.lit(""))

    split = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return F.when(F.pmod(h, F.lit(10)) == 0, F.transform(F.array(split), planted)[0]).otherwise(text)
