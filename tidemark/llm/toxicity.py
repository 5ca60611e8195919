"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The units are words: lower-cased letters only, so `id.iot` and `idiot!!` are the same unit, and three or
more letters standing alone one after another (`i d i o t`) are one unit too. Two units are compared by
the normalised gap-weighted subsequence kernel, which still sees an insult with letters put in between.
Labelled sentences yield the landmarks (units that stand out in toxic documents), the positive units
(landmarks and copies with inserted letters) and the negative ones (units of clean sentences, those
nearest to a landmark first). A unit's kernel values at the landmarks, whitened by the landmarks' own
kernel matrix, go into the machine; a document's score is a logistic curve over its highest unit.

Kernel values are raised to a power, which is a kernel again and parts an insult from words that hold most
of it, and those below `floor` count as 0. Whether a unit can reach the floor is decided by an exact bound
over the letters it shares with a landmark, so the kernel is worked out for few units.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_logistic, in_fold, labelled_sample, prior_shift, sigmoid

LONGEST = 24
SPACED = re.compile(r"(?<!\S)[^\W\d_](?:[ \t.*_-]+[^\W\d_]){2,}(?!\S)")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def unit(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def raw_units(text: str) -> set[str]:
    """The distinct lower-cased words of a text, and its runs of single letters put together."""
    low = text.lower()
    found = set(low.split())
    for run in SPACED.findall(low):
        found.add(unit(run))
    return found


def pieces(word: str) -> list[str]:
    """A unit as the kernel takes it: long ones in overlapping pieces, so that each stays within LONGEST letters."""
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def codes(words: list[str]) -> np.ndarray:
    """Code points, one row a word, padded with zeros."""
    width = max(map(len, words), default=1) or 1
    raw = "".join(w.ljust(width, "\0") for w in words)
    return np.frombuffer(raw.encode("utf-32-le", "replace"), "<u4").reshape(len(words), width)


def subsequence_kernel(match: np.ndarray, n: int, decay: float) -> np.ndarray:
    """Gap-weighted subsequence kernel of order n for many pairs of words at once.

    `match[i, j, ...]` says whether letter i of the one word equals letter j of the other, for each pair;
    the recursion over prefixes runs on whole arrays of pairs.
    """
    s, t, *shape = match.shape
    prefix = [[np.ones(shape)] * (t + 1)] * (s + 1)
    for _ in range(n - 1):
        zero = np.zeros(shape)
        rows = [[zero] * (t + 1)]
        for i in range(s):
            line, row = zero, [zero]
            for j in range(t):
                line = decay * line + np.where(match[i, j], decay**2 * prefix[i][j], 0.0)
                row.append(decay * rows[-1][j + 1] + line)
            rows.append(row)
        prefix = rows
    total = np.zeros(shape)
    for i in range(s):
        for j in range(t):
            total += np.where(match[i, j], prefix[i][j], 0.0)
    return decay**2 * total


def own_matches(a: np.ndarray) -> np.ndarray:
    """Matches of each row with itself; the zeros that pad rows match nothing."""
    x = np.ascontiguousarray(a.T)
    return (x[:, None] == x[None, :]) & (x[:, None] != 0)


def pair_matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matches of each row of `a` with the same row of `b`."""
    x, y = np.ascontiguousarray(a.T)[:, None], np.ascontiguousarray(b.T)[None, :]
    return (x == y) & (x != 0)


def letter_masks(words: list[str]) -> np.ndarray:
    """Which letters a word has, as bits of the code point modulo 64 (more letters than it has, at most)."""
    return np.array([sum({1 << (ord(c) & 63) for c in w}) for w in words], np.uint64)


@dataclass
class ToxicityModel:
    """`bounds[j][m]`: the highest kernel value that landmark j can have with a word sharing letter subset m with it."""

    landmarks: list[str]
    order: int
    decay: float
    floor: float
    power: int
    whitener: np.ndarray
    weights: np.ndarray
    curve: tuple[float, float]

    def __post_init__(self):
        if self.landmarks:
            self.points = codes(self.landmarks)
            self.norms = np.sqrt(self.own(self.landmarks))
            self.letters = [[bit for bit, _ in Counter(ord(c) & 63 for c in w).most_common(9)] for w in self.landmarks]
            self.bounds = [self.subset_bounds(j) for j in range(len(self.landmarks))]

    def own(self, words: list[str]) -> np.ndarray:
        return subsequence_kernel(own_matches(codes(words)), self.order, self.decay)

    def subset_bounds(self, j: int) -> np.ndarray:
        """By Cauchy and Schwarz on the subsequences made of the shared letters: sqrt of their share of the
        landmark's own kernel. Letters beyond the nine commonest of a landmark count as shared."""
        letters, row = self.letters[j], codes([self.landmarks[j]])[0]
        subsets = np.arange(1 << len(letters))
        rows = np.repeat(row[None, :], len(subsets), axis=0)
        for i, bit in enumerate(letters):
            rows[np.ix_((subsets >> i & 1) == 0, (row & 63) == bit)] = 0
        return np.sqrt(subsequence_kernel(own_matches(rows), self.order, self.decay)) / self.norms[j]

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, landmark) places of the pairs that may reach the floor."""
        masks, found = letter_masks(words), []
        for j, (letters, bound) in enumerate(zip(self.letters, self.bounds, strict=True)):
            shared = np.zeros(len(words), np.int64)
            for i, bit in enumerate(letters):
                shared |= (masks >> np.uint64(bit) & np.uint64(1)).astype(np.int64) << i
            at = np.flatnonzero(bound[shared] >= self.floor)
            found.append((at, np.full(len(at), j)))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def kernels(self, words: list[str], at_once: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that reach the floor at some landmark, and their normalised kernel with each, raised to `power` and 0 below the floor."""
        word, mark = self.near(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.lexsort((mark, word, sizes[word]))
        word, mark, value = word[order], mark[order], np.zeros(len(order))
        for i in range(0, len(word), at_once):
            some, index = np.unique(word[i : i + at_once], return_inverse=True)
            a = codes([words[k] for k in some])
            norm = np.sqrt(np.maximum(subsequence_kernel(own_matches(a), self.order, self.decay), 1e-300))
            m = mark[i : i + at_once]
            value[i : i + at_once] = subsequence_kernel(pair_matches(a[index], self.points[m]), self.order, self.decay) / norm[index] / self.norms[m]
        reach = value >= self.floor
        rows, index = np.unique(word[reach], return_inverse=True)
        out = np.zeros((len(rows), len(self.landmarks)))
        out[index, mark[reach]] = value[reach] ** self.power
        return rows, out

    def features(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)))
        rows, values = self.kernels(words)
        out[rows] = values
        return out

    def decide(self, words: list[str]) -> np.ndarray:
        """The machine's value for each word; a word that reaches no landmark has that of the zero vector."""
        out = np.full(len(words), self.weights[-1])
        if self.landmarks and words:
            parts = [(i, p) for i, w in enumerate(words) for p in pieces(w) if len(p) >= self.order]
            if parts:
                rows, values = self.kernels([p for _, p in parts])
                np.maximum.at(out, [parts[k][0] for k in rows], values @ self.whitener @ self.weights[:-1] + self.weights[-1])
        return out

    def score(self, highest: np.ndarray) -> np.ndarray:
        return sigmoid(self.curve[0] * highest + self.curve[1])


class UnitScorer:
    """Highest decision value among a text's units. Remembers units, about `most` of each kind; what goes is worked out again."""

    def __init__(self, model: ToxicityModel, most: int = 800_000):
        self.model, self.most, self.plain, self.high = model, most, set(), {}

    def highest(self, texts: list[str]) -> list[float]:
        found = [raw_units(t) for t in texts]
        new = list(set().union(*found) - self.plain - self.high.keys()) if found else []
        cores = {u: i for i, u in enumerate({unit(w) for w in new})}
        value = self.model.decide(list(cores)).tolist()
        base = float(self.model.weights[-1])
        for w in new:
            v = value[cores[unit(w)]]
            if v > base:
                self.high[w] = v
            else:
                self.plain.add(w)
        out = [max((self.high[w] for w in units & self.high.keys()), default=base) for units in found]
        for seen in (self.plain, self.high):
            if len(seen) > self.most:
                seen.clear()
        return out


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1e4, steps: int = 60) -> np.ndarray:
    """Weights and, last, the bias of a squared-hinge support vector machine (classes weigh the same in total), by Newton's method."""
    a, sign = np.c_[x, np.ones(len(x))], np.where(y == 1, 1.0, -1.0)
    share = cost * weight / np.where(y == 1, weight[y == 1].sum(), weight[y == 0].sum())
    w, ridge = np.zeros(a.shape[1]), np.eye(a.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        slack = 1 - sign * (a @ w)
        on = slack > 0
        g = ridge @ w - 2 * (a[on] * (share * sign * slack)[on, None]).sum(axis=0)
        h = ridge + 2 * (a[on] * share[on, None]).T @ a[on]
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def stand_outs(toxic: list[set[str]], clean: list[set[str]], least: int, share: float, most: int) -> list[str]:
    """Units in at least `least` toxic documents (or `share` of them) that are far rarer in clean ones, strongest first.

    The evidence, documents times log odds, has to exceed what the luckiest of so many units shows by chance, the log
    of their number, by 9, as texts come in copies. So the bar falls with the number of labels.
    """
    pos, neg = Counter(u for s in toxic for u in s), Counter(u for s in clean for u in s)
    need = max(least, share * len(toxic))
    ratio = (len(clean) + 1) / (len(toxic) + 1)
    odds = {u: n * math.log((n + 0.1) * ratio / (neg[u] + 0.1)) for u, n in pos.items() if n >= need and n * ratio >= 12 * neg[u]}
    bar = math.log(len(pos) + 1) + 9
    ranked = sorted((u for u in odds if odds[u] >= bar), key=lambda u: (-odds[u], u))
    if not ranked:
        return []
    held = np.array([[u in s for s in toxic] for u in ranked[: 8 * most]], np.float32)
    within = held @ held.T >= 0.9 * held.sum(axis=1, keepdims=True)
    chosen, told = [], np.zeros(len(toxic), bool)
    for i, u in enumerate(ranked[: 8 * most]):
        # the other words of a toxic text's copies stand out too, all in the same documents: they tell nothing new
        new = np.sum(held[i].astype(bool) & ~told) >= max(1, 0.001 * len(toxic))
        if len(chosen) < most and (new or within[i].sum() <= 2):
            chosen.append(u)
            told |= held[i].astype(bool)
    return chosen


def spread(units: list[str], order: int, decay: float, most: int, close: float = 0.5) -> list[str]:
    """The strongest units, without those whose kernel with a chosen one is `close` or more."""
    if not units:
        return []
    points = codes(units)
    norm = np.sqrt(np.maximum(subsequence_kernel(own_matches(points), order, decay), 1e-300))
    chosen: list[int] = []
    for i in range(len(units)):
        if len(chosen) < most and chosen:
            k = subsequence_kernel(pair_matches(np.repeat(points[i : i + 1], len(chosen), axis=0), points[chosen]), order, decay)
            if (k / norm[i] / norm[chosen]).max() >= close:
                continue
        if len(chosen) < most:
            chosen.append(i)
    return [units[i] for i in chosen]


def distort(word: str) -> list[str]:
    """Copies with one letter put in at each inner place, from a fixed cycle of letters."""
    filler = "xqjzaeo"
    return [word[:i] + filler[(i + len(word)) % len(filler)] + word[i:] for i in range(1, len(word))]


def fit_toxicity(
    rows: list[tuple[int, str, int]], counts: tuple[int, int], order: int = 3, decay: float = 0.6, floor: float = 0.5, power: int = 2, landmarks: int = 64, most: int = 300, least: int = 3, share: float = 0.01
) -> ToxicityModel:
    """From labelled texts: landmarks, machine, and a curve whose intercept suits the class shares in `counts`.

    Without toxic units every text gets the toxic labels' share as its score.
    """
    sentences = [(y, [{u for w in raw_units(s) if len(u := unit(w)) >= order} for s in SENTENCE.split(text)]) for _, text, y in rows]
    whole = [(y, set().union(*s)) for y, s in sentences]
    strong = [u for u in stand_outs([s for y, s in whole if y], [s for y, s in whole if not y], least, share, most) if len(u) <= LONGEST]
    marks = spread(strong, order, decay, landmarks)
    labels = np.array([y for y, _ in whole], float)
    blank = ToxicityModel([], order, decay, floor, power, np.zeros((0, 0)), np.zeros(1), (0.0, float(np.log((counts[1] + 1) / (counts[0] + 1)))))
    if not marks or not 0 < labels.sum() < len(labels):
        return blank
    model = ToxicityModel(marks, order, decay, floor, power, np.eye(len(marks)), np.zeros(len(marks) + 1), (1.0, 0.0))
    values, vectors = np.linalg.eigh(model.features(marks))
    model.whitener = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    clean = sorted(set().union(*[s for y, lines in sentences if not y for s in lines]) - set(strong))
    clean = [w for w in clean if len(w) <= LONGEST]
    rows, values = model.kernels(clean) if clean else ([], np.zeros((0, len(marks))))
    hardest = values[np.argsort(-values.max(axis=1), kind="stable")[:2000]] if len(rows) else values
    positive = strong + [d for m in marks for d in distort(m) if len(d) <= LONGEST]
    x = np.r_[model.features(positive), hardest, np.zeros((1, len(marks)))]  # the last is what most clean units are
    y = np.r_[np.ones(len(positive)), np.zeros(len(x) - len(positive))]
    seen = np.arange(len(x)) < len(strong)  # units as they stand in the texts outweigh the made-up copies
    tell = (x != 0).any(axis=1) | (y == 0)  # a copy that no landmark sees says nothing
    x, y, seen = x[tell], y[tell], seen[tell]
    weight = np.where(seen, 5.0, 1.0)
    weight[-1] = 1 + len(hardest)
    model.weights = linear_svm(x @ model.whitener, y, weight)
    every = sorted(set().union(*[s for _, s in whole]))
    value = dict(zip(every, model.decide(every).tolist(), strict=True))
    highest = np.array([max((value[u] for u in s), default=float(model.weights[-1])) for _, s in whole])
    copies = model.decide([d for m in marks for d in distort(m)[:: max(1, len(m) // 2)]])  # documents whose insult has a letter put in
    y = np.r_[labels, np.ones(len(copies))]
    w = fit_logistic(np.r_[highest, copies], y, ridge=1e-4)
    model.curve = (float(w[0]), float(w[1]) + prior_shift(counts, y))
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, per_class: int = 3000, max_chars: int = 6000) -> ToxicityModel:
    """Fits on at most 2 * `per_class` labelled rows of at most `max_chars` characters, none from the held-out fold."""
    return fit_toxicity(*labelled_sample(docs, labels, "toxic", modulus, held_out, per_class, max_chars))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, highest_unit, score of every row; a null text counts as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = UnitScorer(model)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                high = np.array(scorer.highest([t or "" for t in part.column(1).to_pylist()]), float)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(high), pa.array(model.score(high))], ["doc_id", "highest_unit", "score"])

    return rows.mapInArrow(run, "doc_id long, highest_unit double, score double")


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score (higher: more likely toxic), predicted (1 if score >= `threshold`), highest_unit.

    One row per input row, repeated ids included; null and empty texts have no unit and score what the
    zero vector scores; an empty table gives no rows; columns besides doc_id and text are ignored.
    """
    scored = score_toxicity(docs, train_toxicity(docs, labels, modulus, held_out))
    return scored.select(
        "doc_id",
        in_fold(F.col("doc_id"), modulus, held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "highest_unit",
    )
