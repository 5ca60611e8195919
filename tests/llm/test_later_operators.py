"""Byte-level BPE, periodic runs, whitening, near copies and secrets against plain Python on small, awkward tables."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, periodic_runs, pii, simhash, whitening
from tidemark.llm.queries import queries

SF = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, ids int, runs string, v double, r double"


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(PATH, PATTERN)


@pytest.fixture(scope="module")
def reference_bpe():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


BLOCK = "the same eight words come again and again"
TEXTS = [
    (1, "Hello world, it's 2024!  \n\n\tTabs and  spaces   "),
    (2, None),
    (3, ""),
    (4, " \n\t \x0b"),
    (5, "Größe façade naïve — “quotes” 你好世界 🙂🙂 ​ x"),
    (6, "<|endoftext|> is plain text"),
    (7, (BLOCK + " ") * 9 + "then it ends"),
    (8, "a " * 5000),
    (9, "x" * 3000 + " " + "ab" * 400),
    (10, "one two three " * 4),
    (11, "One odd zyxwvutsrq qzjxk wrd"),
    (12, BLOCK),
    (12, BLOCK),
    (None, (BLOCK + "\n") * 5),
    (10, "one two three " * 8 + "four " + "one two three " * 8),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 1, "x", 0.5, 0.5) for i, t in TEXTS], SCHEMA).repartition(3)


def little(ids):
    return np.array(ids, "<u4").tobytes()


def test_perfect_hash_is_minimal_and_exact():
    keys = [str(i * 7919).encode() for i in range(5000)] + [b"", b"\x00", b"\x00\x00", b"k" * 300]
    table = byte_bpe.PerfectHash(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    assert [table.keys[s] for s in table.find(keys)] == keys
    assert table.find([b"no", b"\x00\x00\x00", b"k" * 299, b"z" * 1000]) == [-1] * 4 and table.find([]) == []
    with pytest.raises(ValueError, match="repeated"):
        byte_bpe.PerfectHash([b"a", b"a"])


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=200))
def test_encode_any_text(bpe, reference_bpe, text):
    ids = bpe.encode([text])[0]
    assert ids == little(reference_bpe.encode_ordinary(text)) and bpe.decode(ids) == text.encode()


def test_long_texts_go_in_parts(bpe, reference_bpe):
    text = "The quick brøwn fox jumps " * 3000 + "y" * 20000 + "?!" * 999
    assert bpe.encode([text], part=1000) == bpe.encode([text]) == [little(reference_bpe.encode_ordinary(text))]


def test_memory_of_merges_is_bounded(reference_bpe):
    small = byte_bpe.ByteBpe(PATH, PATTERN, most=3)
    words = [f"qzx{i}jk{i}" for i in range(50)]
    assert small.encode(words) == [little(reference_bpe.encode_ordinary(w)) for w in words] and len(small.merged) <= 3


def test_encode_and_decode_tables(spark, docs, reference_bpe):
    encoded = byte_bpe.encode_bytes(docs, PATH, PATTERN)
    got = byte_bpe.decode_bytes(encoded, PATH, PATTERN).collect()
    want = sorted((str(i), little(reference_bpe.encode_ordinary(t or "")), (t or "").encode()) for i, t in TEXTS)
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert byte_bpe.encode_bytes(docs.limit(0), PATH, PATTERN).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert byte_bpe.decode_bytes(nothing, PATH, PATTERN).first().decoded == b""


def test_op12_by_name(spark, reference_bpe):
    got = {r.doc_id: r for r in queries()["op12_byte_bpe"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, text in rows:
        ids = reference_bpe.encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(little(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(words, least=24, times=3):
    """Every period by itself, from the smallest."""
    out = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_row(words, least=24, times=3):
    runs = plain_runs(words, least, times)
    best = sorted(runs, key=lambda r: (r[0], r[2]))
    best = [r for r in best if all(r[1] * o[2] >= o[1] * r[2] for o in runs)][:1]
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    first = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), kept


def test_runs_of_random_periodic_sequences():
    r = random.Random(5)
    for _ in range(300):
        k, w = r.choice([1, 2, 3, 5, 30]), []
        for _ in range(r.randrange(1, 6)):
            kind = r.randrange(3)
            if kind == 0:
                w += [r.randrange(k) for _ in range(r.randrange(60))]
            elif kind == 1:
                block = [r.randrange(k) for _ in range(r.randrange(1, 14))]
                w += (block * r.randrange(1, 20))[: r.randrange(1, 200)]
            elif w:
                a = r.randrange(len(w))
                w += w[a : a + r.randrange(80)]
        for least, times in ((24, 3), (6, 3), (24, 5)):
            want = plain_runs(w, least, times)
            assert periodic_runs.find_runs([str(x).encode() for x in w], least, times) == want
            assert [(s, e - s, q) for s, e, q in periodic_runs.runs_of_ids(w, least, times).tolist()] == want


def test_grammar_spells_the_text_and_repeats_no_pair():
    r = random.Random(6)
    for _ in range(50):
        text = [r.randrange(r.choice([1, 2, 4])) for _ in range(r.randrange(80))] * r.randrange(1, 5)
        g = periodic_runs.Grammar(text)
        spell = lambda s: [s] if s < g.letters else [x for t in g.rules[s - g.letters] for x in spell(t)]  # noqa: B023, E731
        assert (spell(g.root) if text else []) == text
        seen, last = set(), None
        for i, pair in enumerate(zip(g.top, g.top[1:])):
            assert pair not in seen or last == (pair, i - 1)  # it may only overlap itself
            if pair not in seen:
                last = (pair, i)
            seen.add(pair)


def test_detect_runs_tables(docs):
    got = periodic_runs.detect_runs(docs).collect()
    rows = sorted(((str(r.doc_id), r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed) for r in got), key=repr)
    assert rows == sorted(((str(i), *plain_row(split(t))) for i, t in TEXTS), key=repr)
    assert all(len(r.runs) == r.n_runs for r in got) and periodic_runs.detect_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="periods"):
        periodic_runs.detect_runs(docs, times=2)


def planted(i, text):
    w = split(text)
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def test_op13_by_name(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries()["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(rows) and sum(r.n_runs for r in got.values())
    for i, text in rows:
        words = planted(i, text)
        r = got[i]
        if len(words) <= 3000:
            *want, kept = plain_row(words)
            assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == (*want, hashlib.sha256(kept.encode()).hexdigest())


def test_planted_tail_of_awkward_rows(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, t) for i in ids for t in (None, "", " \n", "one", BLOCK * 3)] + [(None, BLOCK), (1, "a  b")]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", periodic_runs.with_planted_tail(F.col("doc_id"), F.col("text")).alias("out")).collect()
    assert all(split(r.out) == (planted(r.doc_id, r.text) if r.doc_id is not None else split(r.text)) for r in got) and len(got) == len(rows)


def check_decomposition(a, most):
    d = a.shape[1]
    r = np.linalg.qr(a, "r")
    squares, v = whitening.right_singular(np.vstack([r, np.zeros((d - len(r), d))]), most)
    want = np.r_[np.linalg.svd(a, compute_uv=False), np.zeros(d)][:d] ** 2
    assert np.abs(squares - want).max() <= 1e-13 * max(want[0], 1e-300) + 1e-300
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 2e-12
    assert np.abs(a.T @ (a @ v) - v * squares[: v.shape[1]]).max() <= 1e-12 * max(want[0], 1e-300) + 1e-300


@pytest.mark.parametrize("kind", ["random", "graded", "equal", "two values", "few rows", "zero", "one column", "rank one", "blocks", "twins", "near twins"])
def test_right_singular(kind):
    g = np.random.default_rng(1)
    q = np.linalg.qr(g.normal(size=(40, 40)))[0]
    a = {
        "random": lambda: g.normal(size=(500, 48)),
        "graded": lambda: g.normal(size=(500, 48)) * np.logspace(0, -7, 48),
        "equal": lambda: q,
        "two values": lambda: q * np.r_[np.full(20, 2.0), np.ones(20)] @ q.T,
        "few rows": lambda: g.normal(size=(5, 20)),
        "zero": lambda: np.zeros((4, 6)),
        "one column": lambda: g.normal(size=(50, 1)),
        "rank one": lambda: np.outer(np.arange(9.0), np.ones(5)),
        "blocks": lambda: np.kron(np.eye(6), g.normal(size=(6, 6))),
        "twins": lambda: np.tile(g.normal(size=(100, 8)), 2),
        "near twins": lambda: q * (1 + 1e-9 * np.arange(40)) @ q.T,
    }[kind]()
    check_decomposition(a, min(8, a.shape[1]))


def plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:8]
    return n, ((n * x - s) ** 2).sum(1).tolist(), np.abs(c @ v[:, order] / np.sqrt(e[order])), e[order] / e.sum()


def test_op11_by_name(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    n, deviation, whitened, explained = plain_whitening([r.embedding for r in rows])
    got = queries()["op11_embedding_whitening"](spark, SF).orderBy("vec_id", "component").collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    assert [r.deviation for r in got[::8]] == deviation
    assert np.allclose(np.abs([r.whitened for r in got]).reshape(n, 8), whitened, atol=1e-8)
    assert np.allclose([r.explained for r in got[:8]], explained, rtol=1e-10)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_whitening_of_awkward_rows(spark):
    g = np.random.default_rng(2)
    rows = [(i, [float(x) for x in g.normal(size=4)]) for i in range(30)]
    odd = [(None, rows[0][1]), (1, rows[1][1]), (50, None), (51, []), (52, [1.0, None, 1.0, 1.0]), (53, [1.0, float("nan"), 0.0, 0.0]), (54, [float("-inf"), 0.0, 0.0, 0.0]), (55, [1.0, 2.0])]
    frame = lambda r: spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in r], "vec_id long, embedding array<double>, n int, component double, v string")
    got = whitening.whiten(frame(rows + odd).repartition(3)).collect()
    used = [v for _, v in rows] + [rows[0][1], rows[1][1]]
    n, deviation, whitened, explained = plain_whitening(used)
    assert len(got) == 4 * n and sorted({r.deviation for r in got}) == sorted(set(deviation)) and sum(r.vec_id is None for r in got) == 4
    assert np.allclose(sorted(abs(r.whitened) for r in got if r.component == 1), sorted(whitened[:, 0]))
    assert whitening.whiten(frame(rows).limit(0)).count() == 0 and whitening.whiten(frame(rows[:1])).count() == 0
    flat = whitening.whiten(frame([(i, [float(i), 1.0, float(i)]) for i in range(5)])).collect()
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    tree = whitening.triangle(frame(rows).select("vec_id", F.col("embedding").alias("v")).repartition(20), *[whitening.Centred(1, [0] * 4, 0, 200_000)], fan_in=3)
    x = np.floor(1024 * np.array([v for _, v in rows])) + 100_000
    assert np.allclose(tree.T @ tree, x.T @ x, rtol=1e-12)


def test_deviation_beyond_63_bits_is_null():
    wide = whitening.Centred(2, [0, 0], -(2**40), 2**40)
    assert wide.deviations(np.array([[3, 4], [2**40, 0]])) == [100, None]
    assert whitening.Centred(2, [0, 0], 0, 5).deviations(np.array([[3, 4]])) == [100]


def grouped(pairs, n):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("check", [20, 40])
def test_near_copies_by_brute_force(spark, check):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(600)
    rows = docs.collect()
    fp = np.array([simhash.fingerprint(r.text, 1) for r in rows], np.uint64)
    sig = np.array([simhash.signature(r.text) for r in rows]).view(np.uint64)
    near = [(i, j) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(fp[:i] ^ fp[i]) <= 5) if np.bitwise_count(sig[i] ^ sig[j]).sum() <= check]
    want = grouped(near, len(rows))
    got = {r.doc_id: r.root for r in simhash.near_copies(docs.repartition(5), check=check).collect()}
    same = {}
    for r, w in zip(rows, want, strict=True):
        same.setdefault(w, set()).add(got[r.doc_id])
    assert all(len(s) == 1 for s in same.values()) and len({x for s in same.values() for x in s}) == len(same) and len(near) > 5


def test_signatures_tell_shared_shingles():
    r = random.Random(3)
    words = [f"w{r.randrange(500)}" for _ in range(400)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for edits in (0, 3, 12, 60):
        other = list(words)
        for i in r.sample(range(400), edits):
            other[i] = "new"
        a, b = shingles(words), shingles(other)
        apart = int(np.bitwise_count(simhash.signature(" ".join(words)) ^ simhash.signature(" ".join(other))).sum())
        assert abs(apart - 64 * (1 - len(a & b) / len(a | b))) < 18
    assert not simhash.signature(None).any() and not simhash.signature(" ").any() and simhash.signature("one").any()


SECRETS = [
    '{"password": "hunter2abcXYZ"}', '"api_key":"abcd1234efgh"', "api-key: 'abcd1234efgh'", "export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG", '{\\"token\\": \\"abcd1234efgh\\"}', "secret => abcdefgh12", "auth_token_1 = 'abcdefgh1234'",
]


@pytest.mark.parametrize("text", SECRETS)
def test_secrets_in_quotes(text):
    out, spans = pii.pseudonymise(text, pii.derived_key("k"))
    assert len(spans) == 1 and spans[0][2] == "secret" and out != text and len(out) == len(text)
    assert [re.sub(r"[A-Za-z0-9]", "x", t) for t in (out, text)][0] == re.sub(r"[A-Za-z0-9]", "x", text)


@pytest.mark.parametrize("text", ["secretary: Johannes", "token_count: 12345678", "The password was forgotten", "tokens are counted: elevenwords"])
def test_words_that_are_no_secrets(text):
    assert pii.pseudonymise(text, pii.derived_key("k")) == (text, [])
