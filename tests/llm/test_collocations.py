"""Operator 13 against counts of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import edge_rows

from ratewright.llm import collocations


def brute(rows, least, top):
    """The same by dictionaries of tuples of words; rows of (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lower):
            w = re.findall(r"[^ \t]+", piece)
            n["und" if lang is None else lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(5, len(w) - i) + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least}
        longer = defaultdict(int)
        for p, a in often.items():
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        longer[p[i:j]] = max(longer[p[i:j]], a)
        rows = []
        for p, a in often.items():
            if len(p) > 1 and longer[p] < a:
                score, _, left, right = min((1000 * a * n[lang] // (often[p[:k]] * often[p[k:]]), k, often[p[:k]], often[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got(df, least, top, **more):
    return sorted(map(tuple, collocations.collocations(df, least, top, **more).collect()))


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(5)
    said = ["new york city hall", "by and large", "É là ça va", "one two three four five six seven", "to be or not to be", "ha ha ha ha"]
    rows = []
    for k in range(300):
        words = []
        for _ in range(rng.randrange(1, 60)):
            words.append(rng.choice(said) if rng.random() < 0.3 else rng.choice("the of and a in x y z w".split()))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", "! "]) for w in words)
        rows.append((rng.choice(["en", "fr", None]), text.title() if k % 9 == 0 else text))
    return rows


@pytest.mark.parametrize("least, top, shard", [(100, 2000, 2 << 20), (5, 40, 500), (2, 10_000, 60)])
def test_equals_brute_force(spark, planted, least, top, shard):
    df = spark.createDataFrame(planted, "lang string, text string").repartition(3)
    want = brute(planted, least, top)
    assert got(df, least, top, shard_bytes=shard) == want and any(p.count(" ") == 4 for _, _, p, *_ in want)


def test_a_vocabulary_too_long_to_send_is_joined(spark, monkeypatch, planted):
    monkeypatch.setattr(collocations, "SMALL_WORDS", 0)
    assert got(spark.createDataFrame(planted, "lang string, text string").repartition(3), 5, 40, shard_bytes=500) == brute(planted, 5, 40)


def test_documents(documents):
    rows = [(r.lang, r.text) for r in documents.collect()]
    assert got(documents, 20, 300) == brute(rows, 20, 300)


def test_bitmaps_extend_a_word():
    ids = np.array([3, 5, 3, 5, 0, 3, 3, 5, 5, 0, 0, 5, 3, 5, 3, 5, 3, 3, 5], np.int32)
    maps = collocations.Bitmaps(ids)
    counts = Counter()
    for batch in maps.batches():
        (parent, word, count), bitmap = maps.extend(*batch)
        counts.update({(int(maps.names[a]), int(maps.names[b])): int(c) for a, b, c in zip(parent, word, count, strict=True)})
        (up, third, many), _ = maps.extend(*bitmap)
        counts.update({(int(maps.names[parent[u]]), int(maps.names[word[u]]), int(maps.names[t])): int(c) for u, t, c in zip(up, third, many, strict=True)})
    runs = "".join(map(str, ids)).split("0")
    assert counts == Counter(tuple(map(int, r[i : i + k])) for r in runs for k in (2, 3) for i in range(len(r) - k + 1))


def test_the_filter_passes_all_its_keys(spark):
    rng = np.random.default_rng(2)
    pair, third = rng.integers(1, 1 << 62, 5000), rng.integers(0, 1 << 31, 5000)
    words = collocations._filter(spark.createDataFrame([(int(a), int(b) << 32) for a, b in zip(pair, third, strict=True)], "k1 long, k2 long").repartition(3))
    key = collocations._filter_key
    assert collocations._among(words, key(pair, third)).all() and collocations._among(words, key(pair, third + 1)).mean() < 0.01
    assert not collocations._filter(spark.createDataFrame([], "k1 long, k2 long")).any()


def test_a_full_filter_changes_no_count(spark, monkeypatch, planted):
    monkeypatch.setattr(collocations, "_filter", lambda phrases: np.full(collocations.FILTER_BITS // 64, np.uint64(0xFFFFFFFFFFFFFFFF)))
    assert got(spark.createDataFrame(planted, "lang string, text string"), 5, 40) == brute(planted, 5, 40)


def test_full_tables_change_no_count(spark, monkeypatch, planted):
    monkeypatch.setattr(collocations, "_often", lambda *_: np.full(collocations.PLACES // 8, 255, np.uint8))
    assert got(spark.createDataFrame(planted, "lang string, text string").repartition(3), 5, 40, shard_bytes=500) == brute(planted, 5, 40)


def test_rare_phrases_of_frequent_pairs_make_no_rows(spark, monkeypatch):
    """20 words in any order, so that each pair is frequent and almost no three words are: some 26,000 rows without the tables of sums."""
    rng, made, plain = random.Random(3), [], type(spark.range(1)).mapInArrow
    rows = [("en", " ".join([*rng.choices([f"w{k}" for k in range(20)], k=100), "one two three four five"])) for _ in range(400)]

    def noted(df, func, schema, *more, **options):
        out = plain(df, func, schema, *more, **options)
        made.extend([out] if schema == "k1 long, k2 long, k3 long, n long" else [])
        return out

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", noted)
    assert got(spark.createDataFrame(rows, "lang string, text string").repartition(2), 50, 500, shard_bytes=2000) == brute(rows, 50, 500)
    assert 6 <= sum(out.count() for out in made) < 1000


def test_edges(spark, edges, nothing):
    rows = [(a, t) for _, t, a, _ in edge_rows()]
    assert got(edges, 2, 50) == brute(rows, 2, 50)
    assert got(nothing, 1, 5) == []
    odd = [("", "a b"), (None, "a b"), ("und", "A\x01 b a\x01 b a b"), ("en", ".,;"), ("en", None), ("zz", "q " * 50_000 + "q.")]
    assert got(spark.createDataFrame(odd, "lang string, text string"), 2, 9) == brute(odd, 2, 9)


def test_ties_are_ordered_by_bytes(spark):
    rows = [("en", f"{a} {b}.") for a, b in (("é", "z"), ("z", "é"), ("a\x01", "b"), ("a", "b"), ("A", "b"))] * 3
    found = got(spark.createDataFrame(rows, "lang string, text string"), 3, 9)
    assert found == brute(rows, 3, 9) and len(found) == 4
    assert got(spark.createDataFrame(rows, "lang string, text string"), 3, 2) == found[:2]


def test_counts_beyond_64_bits(spark):
    phrase = lambda w, f: ((w << 32) + 2, 0, 0, 2, f)
    big = 10**13
    phrases = spark.createDataFrame([phrase(1, big), (1 << 32, 0, 0, 1, 3 * big), (2 << 32, 0, 0, 1, 7 * big)], "k1 long, k2 long, k3 long, size int, f long")
    vocabulary = spark.createDataFrame([("en", "x", 3 * big, 1), ("en", "y", 7 * big, 2)], "lang string, word string, f long, wid long")
    totals = spark.createDataFrame([("en", 10**16 + 7)], "lang string, n long")
    row = collocations._scored(phrases.where("size = 2"), phrases, vocabulary, totals).collect()
    assert [r.score for r in row] == [1000 * big * (10**16 + 7) // (21 * big * big)]
