"""Language identification by interpolated Kneser-Ney character models.

One model per language over the letters of padded words, all kept together: for each order one sorted
array of n-gram hashes with a column of log probabilities per language, and one sorted array of context
hashes with the back-off weights. A text gets the language with the lowest cross-entropy per character.
Its score is the posterior at a temperature fitted on held-back training texts, and a text whose best
cross-entropy lies above what its language's held-back texts reach is marked as rejected.

Words are scored once per Python worker and remembered, so a text costs one look-up a word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold

ORDER = 5
START, END = 2, 3


def gram_hashes(points: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """For k = 1..order the 64-bit hashes of the k code points that end at each position."""
    x = points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    out, shifted = [x], x
    for k in range(1, order):
        shifted = np.r_[np.zeros(1, np.uint64), shifted[:-1]]
        out.append(out[-1] * np.uint64(0x100000001B3) + shifted * np.uint64(2 * k + 1) + np.uint64(k))
    return out


def padded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, each with start marks before and an end mark after it; the positions
    that are predicted (letters and end marks); the word of each such position."""
    pad = chr(START) * (ORDER - 1)
    points = np.frombuffer("".join(pad + w + chr(END) for w in words).encode("utf-32-le", "replace"), "<u4")
    at = np.flatnonzero(points != START)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    return points, at, np.repeat(np.arange(len(words)), sizes)


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


@dataclass
class Level:
    """The n-grams of one order that any language has: log2 probabilities, and back-off weights by context."""

    keys: np.ndarray
    values: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `wanted` in the sorted `keys`, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class LanguageModel:
    languages: list[str]
    levels: list[Level]
    base: float
    temperature: float
    limits: np.ndarray

    def log_probabilities(self, hashes: list[np.ndarray]) -> np.ndarray:
        """log2 probability of each position in each language."""
        out = np.zeros((len(hashes[0]), len(self.languages)), np.float32)
        left = np.arange(len(out))
        for k in range(ORDER, 0, -1):
            level = self.levels[k - 1]
            at, hit = find(level.keys, hashes[k - 1][left])
            out[left[hit]] += level.values[at[hit]]
            left = left[~hit]
            if not len(left):
                return out
            context = hashes[k - 2][left - 1] if k > 1 else np.zeros(len(left), np.uint64)
            at, hit = find(level.contexts, context)
            out[left[hit]] += level.backoff[at[hit]]
        out[left] += self.base
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """Per word the log2 probability in each language and, last, the number of characters predicted."""
        out = np.zeros((len(words), len(self.languages) + 1))
        cores = [letters(w) for w in words]
        some = [i for i, c in enumerate(cores) if c]
        if some:
            points, at, owner = padded([cores[i] for i in some])
            p = self.log_probabilities(gram_hashes(points))[at]
            ends = np.flatnonzero(np.diff(owner, prepend=-1))
            out[some, :-1] = np.add.reduceat(p, ends, axis=0)
            out[some, -1] = np.diff(np.r_[ends, len(owner)])
        return out

    def entropies(self, totals: np.ndarray) -> np.ndarray:
        return -totals[:, :-1] / np.maximum(totals[:, -1:], 1)


def fit_level(counts: list[tuple[np.ndarray, np.ndarray]], keys: np.ndarray, context: np.ndarray, lower: np.ndarray) -> Level:
    """Interpolated Kneser-Ney for one order: per language (n-grams, counts); `keys` all n-grams with their
    contexts and with the probabilities of their suffixes one order lower (or the base probability)."""
    contexts = np.unique(context)
    values = np.zeros((len(keys), len(counts)), np.float32)
    backoff = np.zeros((len(contexts), len(counts)), np.float32)
    place = np.searchsorted(contexts, context)
    for i, (grams, n) in enumerate(counts):
        c = np.zeros(len(keys))
        c[np.searchsorted(keys, grams)] = n
        once, twice = np.sum(n == 1), np.sum(n == 2)
        discount = once / (once + 2 * twice) if once and twice else 0.5
        total = np.bincount(place, c, len(contexts))
        kinds = np.bincount(place, c > 0, len(contexts))
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1e-300), 1.0)
        p = np.where(total[place] > 0, np.maximum(c - discount, 0) / np.maximum(total[place], 1e-300), 0) + weight[place] * lower[:, i]
        values[:, i], backoff[:, i] = np.log2(p), np.log2(weight)
    return Level(keys, values, contexts, backoff)


def fit_language_model(rows: list[tuple[str, str]]) -> LanguageModel:
    """From (language, text) pairs: every fourth text of a language is held back for temperature and limits."""
    languages = sorted({lang for lang, _ in rows})
    vocabulary = {lang: Counter() for lang in languages}
    held, seen = [], Counter()
    for lang, text in rows:
        seen[lang] += 1
        if seen[lang] % 4:
            vocabulary[lang].update(c for w in text.lower().split() if (c := letters(w)))
        else:
            held.append((lang, text))
    words = sorted(set().union(*vocabulary.values())) if languages else []
    points, at, owner = padded(words)
    hashes = gram_hashes(points)
    base = 1.0 / (len(np.unique(points)) + 1)
    levels: list[Level] = []
    weights = [np.array([vocabulary[lang][w] for w in words], float)[owner] if words else np.zeros(0) for lang in languages]
    present = [w > 0 for w in weights]
    for k in range(1, ORDER + 1):
        keys, first = np.unique(hashes[k - 1][at], return_index=True)
        context = hashes[k - 2][at[first] - 1] if k > 1 else np.zeros(len(keys), np.uint64)
        counts = []
        for i in range(len(languages)):
            if k == ORDER:
                grams, inverse = np.unique(hashes[k - 1][at][present[i]], return_inverse=True)
                counts.append((grams, np.bincount(inverse, weights[i][present[i]], len(grams))))
            else:  # how many different characters stand before it
                longer, one = np.unique(hashes[k][at][present[i]], return_index=True)
                counts.append(np.unique(hashes[k - 1][at][present[i]][one], return_counts=True))
        if k == 1:
            lower = np.full((len(keys), len(languages)), base)
        else:
            lower = 2.0 ** levels[-1].values[np.searchsorted(levels[-1].keys, hashes[k - 2][at[first]])].astype(float)
        levels.append(fit_level(counts, keys, context, lower))
    model = LanguageModel(languages, levels, float(np.log2(base)), 1.0, np.full(len(languages), np.inf))
    calibrate(model, held)
    return model


def calibrate(model: LanguageModel, held: list[tuple[str, str]]) -> None:
    """The temperature that makes the held-back texts likeliest, and each language's rejection limit: its
    held-back texts' 99.5 % quantile of cross-entropy plus half a bit (no texts: no limit)."""
    totals = np.array([model.words(text.lower().split()).sum(axis=0) for _, text in held]).reshape(len(held), len(model.languages) + 1)
    truth = np.array([model.languages.index(lang) for lang, _ in held], int)
    keep = totals[:, -1] > 0
    h, truth = model.entropies(totals)[keep], truth[keep]
    if len(truth):
        grid = 2.0 ** np.arange(-2, 8, 0.25)
        model.temperature = float(min(grid, key=lambda t: -np.log(posterior(h, t)[np.arange(len(truth)), truth] + 1e-12).sum()))
    for i in range(len(model.languages)):
        if np.any(truth == i):
            model.limits[i] = np.quantile(h[truth == i, i], 0.995) + 0.5


def posterior(entropies: np.ndarray, temperature: float) -> np.ndarray:
    z = -temperature * (entropies - entropies.min(axis=1, keepdims=True))
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def train_language_model(docs: DataFrame, modulus: int = 5, held_out: int = 0, rows_per_language: int = 600, max_chars: int = 20_000) -> LanguageModel:
    """Fits on about `rows_per_language` texts a language of at most `max_chars` characters, none held out.

    Texts are sampled by the hash of their id at a rate from the languages' row counts, so the sample is
    the same however the table is split. Null languages and texts are skipped.
    """
    known = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text"), F.col("lang").cast("string").alias("_lang")).where(
        F.col("_id").isNotNull() & F.col("_lang").isNotNull() & F.col("_text").isNotNull() & ~in_fold(F.col("_id"), modulus, held_out)
    )
    sizes = known.groupBy("_lang").count()
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) / F.lit(1 << 30)
    rows = (
        known.where(F.length("_text") <= max_chars)
        .join(F.broadcast(sizes), "_lang")  # a row a language
        .where(place * F.col("count") < rows_per_language)
        .select("_lang", "_text", "_id")
        .collect()
    )
    return fit_language_model([(r["_lang"], r["_text"]) for r in sorted(rows, key=lambda r: (r["_id"], r["_text"]))])


def score_languages(docs: DataFrame, model: LanguageModel, most_words: int = 400_000) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, rejected of every row.

    A null text, or one without a letter, is `und` with score 0 and rejected; so is every text if no
    language was learned. A worker remembers at most `most_words` words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        table = np.zeros((0, len(model.languages) + 1))
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                split = [(t or "").lower().split() for t in part.column(1).to_pylist()]
                new = list(set().union(*split).difference(known)) if split else []
                if len(known) + len(new) > most_words:
                    known, table = {}, table[:0]
                    new = list(set().union(*split))
                known.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                table = np.concatenate([table, model.words(new)]) if new else table
                totals = np.array([table[[known[w] for w in words]].sum(axis=0) for words in split]).reshape(len(split), len(model.languages) + 1)
                yield pa.RecordBatch.from_arrays([part.column(0), *verdicts(model, totals)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def verdicts(model: LanguageModel, totals: np.ndarray) -> list[pa.Array]:
    some = (totals[:, -1] > 0) & bool(model.languages)
    if not some.any():
        n = len(totals)
        return [pa.array(["und"] * n), pa.array([0.0] * n), pa.array([None] * n, pa.float64()), pa.array([True] * n)]
    h = model.entropies(totals)
    best = h.argmin(axis=1)
    at = np.arange(len(h))
    return [
        pa.array([model.languages[i] if s else "und" for i, s in zip(best, some, strict=True)]),
        pa.array(np.where(some, posterior(h, model.temperature)[at, best], 0.0)),
        pa.array(h[at, best], mask=~some),
        pa.array(~some | (h[at, best] > model.limits[best])),
    ]


def identify_languages(docs: DataFrame, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected.

    One row per input row, repeated ids included; an empty table gives no rows; columns besides doc_id,
    text and lang are ignored.
    """
    scored = score_languages(docs, train_language_model(docs, modulus, held_out))
    return scored.withColumn("held_out", in_fold(F.col("doc_id"), modulus, held_out)).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
