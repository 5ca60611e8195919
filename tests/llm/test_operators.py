"""The dealt operators against plain Python on small, awkward tables."""

import hashlib
import pathlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, license_scan, packing, pii, quality_classifier, simhash, toxicity
from tidemark.llm.components import connected_components
from tidemark.llm.decontaminate import find_contamination
from tidemark.llm.license_scan import scan_licenses
from tidemark.llm.packing import pack_documents
from tidemark.llm.pii import protect
from tidemark.llm.quality_rules import judge_lines
from tidemark.llm.queries import queries, tokenizer_path
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.substring_dedup import Windows, remove_repeats

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp int"
WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + "."


TEXTS = [
    (1, prose(1, 120)),
    (2, prose(1, 120)),  # a copy
    (3, prose(2, 30) + "\n" + prose(1, 120)[10:500] + "\n" + prose(3, 40)),
    (4, None),
    (5, ""),
    (6, " \n\t \x0b"),
    (7, "one two three"),
    (8, "Wort " * 300),
    (9, "É x ẞ É"),
    (10, prose(5, 5000)),
    (11, "a | b | c | d | e\n" * 20),
    (12, prose(7, 60)),
    (12, prose(8, 60)),  # a repeated id
    (12, prose(8, 60)),  # and a repeated row
    (None, prose(1, 120)),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1) for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def removed(rows, window=50):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((str(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def test_substring_dedup(docs, empty):
    got = remove_repeats(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == removed(TEXTS)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    short = remove_repeats(docs, window=10, first=3).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in short) == removed(TEXTS, 10)
    assert remove_repeats(empty).count() == 0


def test_window_hashes_follow_the_words():
    w = Windows([x.encode() for x in (prose(1, 40) + " " + prose(1, 40)).split()])
    h = w.hashes(40)
    assert h[0] == h[40] and len(set(h.tolist())) == 40
    assert (w.signature(10, 20) == [w.hashes(10)[i : i + 11].min() for i in range(61)]).all()


def test_quality_rules(docs, empty):
    got = judge_lines(docs).collect()
    assert len(got) == len(TEXTS) and judge_lines(empty).count() == 0
    want = []
    for i, t in TEXTS:
        w = words(t)
        c = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want.append((str(i), len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    kept = {r.doc_id: r.kept for r in got}
    for r in got:
        share = len(words(r.cleaned)) / max(r.n_words, 1)
        assert r.kept_share == pytest.approx(share if r.n_words else 1.0) and r.kept == (not r.base_failed and r.kept_share >= 0.5)
    assert kept[1] and not kept[11] and not kept[4] and not kept[8]


def test_line_rules_one_by_one(spark):
    text = prose(1, 60)
    long = " ".join(prose(2, 40).replace(".", "").split())
    cases = {
        "Home | News | Sport | Weather": False,
        "Home > News > Sport > Weather": False,
        "a / b": True,
        "Home\nNews\nSport": False,
        "A heading\n" + text: True,
        long + "\nAnother line.": False,
        long + "\nand on it goes.": True,
        long + "!": True,
        "(c) 2024 Acme Inc. All rights reserved.": False,
        "Visit example.com to subscribe": False,
        text + " They subscribe. " + text: True,
        "THIS IS ALL VERY LOUD.": False,
        "so $$$ many ### signs &&& here.": False,
        "again " * 20 + ".": False,
        "|" * 200_000: False,
        "(" * 200_000 + "x.": True,
        "a " * 200_000: False,
        "x | " * 100_000: False,
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r in judge_lines(rows).select("doc_id", "cleaned").collect():
        line = list(cases)[r.doc_id].split("\n")[0]
        assert (r.cleaned.split("\n")[0] == line) == cases[list(cases)[r.doc_id]], line[:60]


def slow_kernel(s, t, n, decay):
    """The kernel by its definition: all index pairs."""
    from itertools import combinations

    total = 0.0
    for a in combinations(range(len(s)), n):
        for b in combinations(range(len(t)), n):
            if [s[i] for i in a] == [t[i] for i in b]:
                total += decay ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_subsequence_kernel():
    pairs = [("idiot", "idxiot"), ("trash", "station"), ("ab", "abc"), ("moron", "moron")]
    a, b = toxicity.codes([p for p, _ in pairs]), toxicity.codes([q for _, q in pairs])
    got = toxicity.subsequence_kernel(toxicity.pair_matches(a, b), 3, 0.6)
    assert got == pytest.approx([slow_kernel(p, q, 3, 0.6) for p, q in pairs])


def labelled(n=160):
    rows = []
    for i in range(n):
        t = prose(i, 25)
        rows.append((i, t.replace("dolor", "blockhead", 1) + " you blockhead" if i % 4 == 0 else t, int(i % 4 == 0)))
    return rows


def test_toxicity_sees_inserted_letters(spark, docs, empty):
    rows = labelled()
    model = toxicity.fit_toxicity(rows, (120, 40))
    assert "blockhead" in model.landmarks
    scorer = toxicity.UnitScorer(model)
    bad, gap, fine, none = model.score(np.array(scorer.highest(["Such a BLOCK-HEAD!", "you bloxckhead", prose(900, 30), ""])))
    assert bad > 0.3 and gap > 0.3 and fine < 0.3 and none < 0.3
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.fit_toxicity([], (0, 0)).score(np.array([0.0]))[0] == pytest.approx(0.5)


def test_forgetting_units_changes_no_score():
    model = toxicity.fit_toxicity(labelled(), (120, 40))
    texts = [t for _, t, _ in labelled(60)] + ["x" * 100_000, "you blockhead " * 5000]
    small, large = toxicity.UnitScorer(model, most=3), toxicity.UnitScorer(model)
    assert [small.highest([t])[0] for t in texts] == [large.highest([t])[0] for t in texts] == large.highest(texts)


def test_few_labels_still_give_landmarks():
    rows = [r for r in labelled(64)]
    assert "blockhead" in toxicity.fit_toxicity(rows, (48, 16)).landmarks


def test_kernel_bound_loses_nothing():
    model = toxicity.fit_toxicity(labelled(), (120, 40))
    rng = np.random.default_rng(3)
    units = ["".join(rng.choice(list("blockheadxy"), rng.integers(3, 12))) for _ in range(300)]
    k = np.array([[slow_kernel(u, m, 3, 0.6) / np.sqrt(max(slow_kernel(u, u, 3, 0.6), 1e-300) * slow_kernel(m, m, 3, 0.6)) for m in model.landmarks] for u in units])
    want = np.where(k >= model.floor, k**model.power, 0)
    assert model.features(units) == pytest.approx(want, abs=1e-9)


def test_packing_is_an_exact_cover(docs, empty):
    path = tokenizer_path()
    got = pack_documents(docs.where("doc_id is not null"), path, window=256, with_ids=True).collect()
    encoder = packing.WordTokenizer(path).encoder
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
    want = Counter(tuple([i, *encoder.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in TEXTS if i is not None)
    single = {i for i, n in Counter(i for i, _ in TEXTS).items() if n == 1 and i is not None}
    for i in single:
        pieces = sorted((r.start, r.ids) for r in got if r.doc_id == i)
        assert (i, *[x for _, ids in pieces for x in ids]) in want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at == 256 or at & (at - 1) == 0
    assert sum(r.length for r in got) == sum(n * (len(k) - 1) for k, n in want.items())
    assert pack_documents(empty, path).count() == 0


def test_level_choice_minimises_squares():
    p = packing.SquaresPacker(16)
    rng = np.random.default_rng(0)
    for _ in range(200):
        p.counts[1:16] = rng.integers(0, 4, 15)
        s = int(rng.integers(1, 16))

        def squares(level, s=s):
            c = p.counts.copy()
            if level:
                c[level] -= 1
            if level + s < 16:
                c[level + s] += 1
            return int((c[1:16] ** 2).sum())

        usable = [h for h in range(0, 17 - s) if h == 0 or p.counts[h]]
        assert squares(p.best_level(s)) == min(map(squares, usable))


def test_license_scan(spark):
    text = "x y z\nLicensed under the  APACHE license, version 2.0!\nmore words here"
    rows = spark.createDataFrame([(1, text), (2, "nothing to see"), (3, None), (None, "Released under the MIT License.")], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.best_dice) for r in scan_licenses(rows).collect()}
    assert got == {1: (["Apache-2.0"], 1.0), 2: ([], None), 3: ([], None), None: (["MIT"], 1.0)}
    assert scan_licenses(rows.limit(0)).count() == 0


def test_licence_families_and_texts(spark):
    folder = pathlib.Path(license_scan.__file__).parent / "licenses"
    texts = {
        "All rights reserved.": ["Proprietary"],
        "Copyright 2024 Acme Inc. All rights reserved.": ["Proprietary"],
        "Licensed under the GNU General Public License, version 2": ["GPL-2.0"],
        "Licensed under the GNU General Public License, version 3": ["GPL-3.0"],
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.": ["LGPL-3.0"],
        "Released under the ISC License.": ["ISC"],
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": ["CC-BY-ND-4.0"],
        "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"],
        "Some words.\nAll rights reserved.\nMore words.\nReleased under the MIT License.": ["MIT", "Proprietary"],
        "The licence of the software was a public matter.": [],
    }
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "Apache-2.0", "MPL-2.0", "CC0-1.0"):
        texts[(folder / f"{name}.txt").read_text() + "\nAdded by us, the authors of it."] = [name]
    cut = license_scan.BSD_2.replace(" 2.", "\n2.").replace("met: ", "met:\n\n").replace("reserved. ", "reserved.\n\n")
    texts[cut + "\n" + license_scan.BSD_3 + "\n\n" + license_scan.BSD_END] = ["BSD-3-Clause"]
    texts[cut + "\n\n" + license_scan.BSD_END] = ["BSD-2-Clause"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in scan_licenses(rows).collect()}
    assert [(t[:60], got[i]) for i, t in enumerate(texts)] == [(t[:60], want) for t, want in texts.items()]


def test_permutations_are_one_to_one():
    for n in (2, 10, 97, 1000):
        out = [pii.permute_other(i, n, b"k", "t") for i in range(n)]
        assert sorted(out) == list(range(n)) and all(i != o for i, o in enumerate(out))
        assert all(pii.permute(pii.permute(i, n, b"k", "t"), n, b"k", "t", back=True) == i for i in range(n))


def test_pii_keeps_formats_and_links(docs, empty, spark):
    text = "card 4041 8949 7460 8795 or 4041894974608795, not 4041894974608796; born 1984-05-17, not 1984-13-45; +1 (724) 555-7058, 42.144.35.254, a.b@mail8.example.com"
    new, spans = pii.pseudonymise(text, b"key")
    assert Counter(k for *_, k in spans) == Counter(card=2, date=1, phone=1, ip=1, email=1)
    for old in ("4041 8949", "40418949746087958"[:16], "1984-05-17", "555-7058", "42.144.35.254", "a.b@"):
        assert old not in new
    assert "4041894974608796" in new and "1984-13-45" in new
    digits = re.findall(r"card ([\d ]+) or (\d+)", new)[0]
    assert digits[0].replace(" ", "") == digits[1] and pii.luhn_digit(digits[1][:-1]) == digits[1][-1]
    got = protect(docs, "key").collect()
    assert len(got) == len(TEXTS) and protect(empty, "key").count() == 0
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in TEXTS)


def test_dates_keep_their_shape_and_never_collide():
    for orders, sizes in ((("ymd",), (4, 2, 2)), (("dmy", "mdy"), (1, 1, 4)), (("dmy", "mdy"), (2, 2, 4)), (("dmy", "mdy"), (1, 2, 4))):
        olds = ["/".join(str(n).zfill(w) for n, w in zip(d, sizes, strict=True)) for d in pii.printed_days(orders, *sizes)[::7]]
        news = [pii.pseudonymise(f"on {d}.", b"key")[0][3:-1] for d in olds]
        assert len(set(news)) == len(olds) and all(a != b for a, b in zip(olds, news, strict=True))
        assert all([len(x) for x in a.split("/")] == [len(x) for x in b.split("/")] for a, b in zip(olds, news, strict=True))
    assert pii.pseudonymise("31/31/2020 and 30.02.2020", b"key")[0] == "31/31/2020 and 30.02.2020"
    assert len(pii.printed_days(("dmy", "mdy"), 2, 2, 4)) == len({(a, b, y) for d, m, y in [(d, m, y) for y, m, d in pii.printed_days(("ymd",), 4, 2, 2)] for a, b in ((d, m), (m, d))})


def test_pii_refuses_an_empty_key(empty):
    with pytest.raises(ValueError):
        protect(empty, "")


def test_pii_beside_other_numbers():
    cards = ["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "3782 822463 10005", "4222222222222", "6304 0000 0000 0000 000"]
    for value in cards:
        alone = pii.pseudonymise(value, b"key")[0]
        assert alone != value
        for around in ("card {} 12/27", "{} 123", "{} 27 items", "27 {}", "12-27 {} 123 2024", "{}-12", "no 1234 5678 {} 99"):
            assert pii.pseudonymise(around.format(value), b"key")[0] == around.format(alone), around.format(value)
    for value in ("ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947", "DE89370400440532013000"):
        alone = pii.pseudonymise(value, b"key")[0]
        assert alone != value
        for around in ("{} BIC", "{} 2024", "{} 2024 1234 EUR", "AB12 3456 7890 {} X", "IBAN {}."):
            assert pii.pseudonymise(around.format(value), b"key")[0] == around.format(alone), around.format(value)
    text = "phone +1 (724) 555-7058 2024 1234 and " + " ".join(str(y) for y in range(1990, 2030))
    new = pii.pseudonymise(text, b"key")[0]
    assert "555-7058" not in new and new.endswith(text[38:])


def test_near_duplicates_by_brute_force(spark, docs, empty):
    import xxhash

    texts = [(i, t) for i, t in TEXTS if i is not None] + [(100 + i, prose(1, 120).replace("lorem", "x", i)) for i in range(12)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")

    def mark(t):
        w = [x.lower() if x.isascii() else x for x in words(t)]
        w = ["".join(c.lower() if c.isascii() else c for c in x) for x in w]
        s = [" ".join(w[k : k + 4]) for k in range(max(len(w) - 3, 1))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = [mark(t) for _, t in texts]
    root = list(range(len(texts)))
    for _ in root:
        for i in range(len(texts)):
            root[i] = min(root[j] for j in range(len(texts)) if bin(fp[i] ^ fp[j]).count("1") <= 4)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, 10**9), texts[i][0])
    want = sorted((texts[i][0], f"{fp[i]:016x}", least[root[i]]) for i in range(len(texts)))
    for blocks in (2, 3, 4):
        assert sorted(map(tuple, near_duplicates(rows, blocks=blocks).select("doc_id", "fingerprint", "component_id").collect())) == want
    assert near_duplicates(empty).count() == 0
    assert near_duplicates(docs).count() == len(TEXTS)


def test_crowded_anchors_lose_no_link(spark):
    rng = np.random.default_rng(5)
    fps = np.unique(np.bitwise_xor(np.uint64(1 << 40), np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    rows = simhash.anchor_rows(df, 4, 3)
    whole = connected_components(simhash.links(rows, 4)).collect()
    assert sorted(map(tuple, connected_components(simhash.links(rows, 4, most=5)).collect())) == sorted(map(tuple, whole))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_decontamination_by_brute_force(spark, docs, empty):
    items = [(1, " ".join(prose(1, 120).split()[20:45])), (2, "Three"), (3, None), (4, "  "), (5, "dolor sit"), (1, " ".join(prose(1, 120).split()[20:45])), (None, "amet")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - 9, 1)) if w and i is not None else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = []
    for i, t in TEXTS:
        w, hit, found = split(t), set(), set()
        for x, ids in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found |= ids
        want.append((str(i), len(w), sorted(hit), sorted(found)))
    for most in (0, 500_000):
        got = find_contamination(docs, bench, most_broadcast=most).collect()
        assert sorted((str(r.doc_id), r.n_words, r.hits, r["items"]) for r in got) == sorted(want)
    assert find_contamination(empty, bench).count() == 0
    assert find_contamination(docs, bench.limit(0)).where("size(hits) > 0").count() == 0


def test_kneser_ney_sums_to_one():
    rows = [("a", "abba abab bab"), ("a", "baba ab"), ("b", "xyzzy zyx"), ("b", "zz top")] * 3
    model = langid.fit_language_model(rows)
    alphabet = [c for c in "abxyztop"] + [chr(langid.END)]
    base = [2, 2, 2, 2, ord("a")]
    total = np.zeros(2)
    for c in alphabet:
        points = np.array([*base, ord(c)], np.uint32)
        total += 2.0 ** model.log_probabilities(langid.gram_hashes(points))[-1]
    assert np.all(total < 1.0001) and np.all(total > 0.8)  # the rest is for unseen characters


def test_language_id(spark, docs, empty):
    rows = [(i, "the house and the garden were quiet in the morning" if i % 2 else "das haus und der garten waren am morgen ganz still", "en" if i % 2 else "de") for i in range(60)]
    known = spark.createDataFrame([*rows, (100, "123 !", "en"), (101, None, None), (102, "", "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify_languages(known).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert langid.identify_languages(empty).count() == 0


def test_quality_classifier(spark, docs, empty):
    rows = [(i, prose(i, 60) if i % 3 else "$$$ ### BUY NOW!! " * 12, int(i % 3 > 0)) for i in range(240)]
    model = quality_classifier.fit_compression_model(rows, (80, 160), dict_bytes=2048)
    table = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(999, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality_classifier.score_quality(table, model).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows]) > 0.95
    assert 0 <= got[999] <= 1 and quality_classifier.score_quality(empty, model).count() == 0


def test_contract_columns(spark):
    known = queries()
    assert sorted(known, key=lambda n: int(n[2:].split("_")[0])) == [
        "op1_substring_dedup", "op2_quality_rules", "op3_toxicity", "op4_packing", "op5_license_scan", "op6_pii", "op7_simhash_near_dedup", "op8_decontamination", "op9_language_id", "op10_quality_classifier",
        "op11_embedding_whitening", "op12_byte_bpe", "op13_periodic_runs",
    ]
    one = known["op1_substring_dedup"](spark, SF)
    assert one.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    row = one.where("n_removed = 0").first()
    text = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") == row.doc_id).first().text
    assert row.kept_sha256 == hashlib.sha256(" ".join(words(text)).encode()).hexdigest()
