"""Each operator against a brute-force version, on the small tables and on awkward rows."""

import os
import time
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
import xxhash
from conftest import DATA, PROSE, edge_rows
from pyspark.sql import functions as F

from ratewright.llm import components, decontam, licenses, linededup, packing, quality, shards, simhash, tokens
from ratewright.llm.store import CLEANUP, Scratch


def ids_and_texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return Counter(map(tuple, rows))


# --- components ---------------------------------------------------------------------------------------------


def test_components_of_a_chain_a_star_and_loops(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 20)] + [(7, 7), (200, 200), (1, 2), (None, 3)]
    got = components.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in got} == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(1, 20), 1)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- 3 ------------------------------------------------------------------------------------------------------


def test_simhash_equals_brute_force(documents):
    rows = ids_and_texts(documents)
    want = brute.near_groups(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(documents).collect()}
    assert got == want


def test_simhash_edges(edges, nothing):
    want = brute.near_groups([(i, t) for i, t, _, _ in edge_rows()])
    got = simhash.simhash_components(edges).select("doc_id", "fingerprint", "component_id").collect()
    assert bag(got) == bag((i, *want[i]) for i, *_ in edge_rows())
    assert want[1] == want[2] == want[3] == ("0" * 16, 1)
    kept = simhash.drop_near_duplicates(edges)
    assert kept.columns == edges.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}
    assert simhash.simhash_components(nothing).count() == 0 == simhash.drop_near_duplicates(nothing).count()


def test_simhash_null_ids(spark):
    df = spark.createDataFrame([(None, PROSE), (4, PROSE), (None, "something else entirely " * 9)], "doc_id long, text string")
    got = simhash.simhash_components(df).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("4", "4"), ("None", "4"), ("None", "None")]
    assert simhash.drop_near_duplicates(df).count() == 3


@pytest.mark.parametrize("hot", [16, 16_384])
def test_index_loses_no_link(spark, hot):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = {int(c) for c in rng.integers(0, 1 << 63, 300, dtype=np.uint64)}
    for c in centres:
        for _ in range(12):
            c = np.bitwise_xor(c, np.uint64(1) << rng.integers(0, 64, dtype=np.uint64))
            c = np.bitwise_xor(c, np.uint64(1) << rng.integers(0, 64, dtype=np.uint64))
            values.add(int(c))
    values = sorted(values)
    fps = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_links(fps, hot_rows=hot).collect()]
    assert all((a ^ b).bit_count() for a, b in links)
    got, want = brute.Sets(), brute.Sets()
    for a, b in links:
        got.join(a, b)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                want.join(a, b)
    assert [got.root(v) for v in values] == [want.root(v) for v in values]


def test_gray_rank_is_the_inverse_of_the_code():
    n = np.arange(1 << 12, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


# --- 4 ------------------------------------------------------------------------------------------------------

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@pytest.mark.parametrize("which", ["documents", "edges"])
def test_quality_equals_brute_force(request, which):
    df = request.getfixturevalue(which)
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]
    want = bag((r[0], *[m[c] for c in MEASURES], failed, kept) for r, (m, failed, kept) in zip(rows, brute.quality(rows), strict=True))
    assert bag(quality.quality_table(df).select("doc_id", *MEASURES, "base_failed", "kept").collect()) == want
    kept = quality.quality_filter(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(k[0] for k in want.elements() if k[-1])


def test_quality_of_nothing(nothing):
    assert quality.quality_table(nothing).count() == 0 == quality.quality_filter(nothing).count()


def test_sketches_merge(spark, documents):
    flat = quality.sketches(documents.select(F.lit("a").alias("lang"), F.lit("b").alias("source"), quality.buckets(quality.measures(F.col("text"))).alias("b")))
    halves = [quality.sketches(documents.where(f"doc_id % 2 = {k}").select(F.lit("a").alias("lang"), F.lit("b").alias("source"), quality.buckets(quality.measures(F.col("text"))).alias("b"))) for k in (0, 1)]
    merged = halves[0].union(halves[1]).groupBy("lang", "source", "name", "bucket").agg(F.sum("n").alias("n"))
    assert bag(merged.collect()) == bag(flat.collect())


# --- 5 ------------------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(documents, edges, nothing):
    from tokenizers import Tokenizer, models

    vocabulary = tokens.read_vocabulary(tokens.default_vocabulary())
    unknown = next(i for i, (p, _) in enumerate(vocabulary) if p == "<unk>")
    exact = Tokenizer(models.Unigram(vocabulary, unknown, True))
    for df in (documents, edges):
        rows = ids_and_texts(df)
        got = bag(tokens.count_tokens(df).select("doc_id", "n_chars", "n_tokens").collect())
        want = bag((i, len(t or ""), len(exact.encode("▁" + t.replace(" ", "▁")).ids) if t else 0) for i, t in rows)
        assert got == want
    assert tokens.count_tokens(nothing).count() == 0


# --- 6 ------------------------------------------------------------------------------------------------------


def shard_of(key, n):
    base = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
    seed = xxhash.xxh64_intdigest(base.to_bytes(8, "little"), 42)
    return max(range(n), key=lambda s: (xxhash.xxh64_intdigest(s.to_bytes(8, "little"), seed) >> 11, s))


@pytest.mark.parametrize("which", ["documents", "edges"])
def test_shards(request, which):
    df = request.getfixturevalue(which)
    got = shards.shard_documents(df, [1.0] * 40, [1.0] * 41).collect()
    want = bag((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), shard_of(i, 40), shard_of(i, 41)) for i, t in ids_and_texts(df))
    assert bag((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    assert all(r.law == "key" and r.grown_shard in (r.shard, 40) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_equal_ids_of_other_types_share_a_shard(spark):
    ids = [0, 1, -5, 17, 123456789, 2**31 - 1]
    base = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")
    want = {r.doc_id: r.shard for r in shards.shard_documents(base, [1.0] * 40).collect()}
    for kind in ("int", "decimal(20,0)", "decimal(12,2)", "double", "string"):
        got = shards.shard_documents(base.withColumn("doc_id", F.col("doc_id").cast(kind)), [1.0] * 40).collect()
        if kind == "string":
            assert {int(r.doc_id): r.shard for r in got} == want
        else:
            assert {int(r.doc_id): r.shard for r in got} == want
    odd = spark.createDataFrame([("a-1", "t"), ("007", "t"), (None, "t")], "doc_id string, text string")
    assert len(shards.shard_documents(odd, [1.0] * 40).collect()) == 3


def test_shards_weights_nulls_and_nothing(spark, nothing):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = Counter(r.shard for r in shards.shard_documents(df, [1.0, 3.0]).select("shard").collect())
    assert 0.72 < n[1] / 20_000 < 0.78
    same = spark.createDataFrame([(None, "a"), (None, None), (1, "b")], "doc_id long, text string")
    assert len({r.shard for r in shards.shard_documents(same, [1.0] * 7).collect() if r.doc_id is None}) == 1
    assert shards.shard_documents(nothing, [1.0] * 3).count() == 0
    with pytest.raises(ValueError):
        shards.shard_documents(df, [1.0, 0.0])


# --- 7 ------------------------------------------------------------------------------------------------------


def test_line_dedup_equals_brute_force(spark, edges):
    w = PROSE.split()
    rows = {i: t for i, t, *_ in edge_rows() if i not in (8, 9)}
    for k in range(40):
        line = w[k % 9 :] + w[: k % 9]
        near = line[:-1] + [line[-1] + "s"]
        rows[100 + k] = "\n".join([f"an opening that is only said here {k * k * 7919} {'abcdefghij'[k % 10] * 5}", " ".join(line), "", " ".join(near).title() + "!", "short line", f"Page {k} of 40 in this fine printed book"])
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    want = brute.line_dedup(list(rows.items()))
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.line_dedup_table(df).collect()}
    assert got == want
    kept = {r.doc_id for r in linededup.line_dedup_filter(df).collect()}
    assert kept == {i for i, (_, n, gone) in want.items() if not gone or gone < n}


def test_line_dedup_edges(edges, nothing):
    got = linededup.line_dedup_table(edges).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in edge_rows())
    by = {r.doc_id: r for r in got}
    assert by[1].text is None and by[2].text == "" and by[5].text == PROSE and by[6].text == "" == by[7].text
    assert sum(r.n_removed for r in got if r.doc_id == 5) == 0  # repeated rows are one document
    assert linededup.line_dedup_filter(edges).columns == edges.columns
    assert linededup.line_dedup_table(nothing).count() == 0


def test_shuffle_files_of_inner_tables_go(spark):
    """Those of a table that is kept for one piece of work are gone once it is written."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    found = lambda: {f for d in folders for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}
    kept = []  # held, so that nothing is left to the garbage collector
    with Scratch(spark, "shuffles") as held:
        before = found()
        kept.append(spark.range(5000).groupBy((F.col("id") % 100).alias("k")).count())
        kept.append(held.keep(kept[0], "counts"))
        until = time.time() + 10
        while (found() - before) and time.time() < until:
            time.sleep(0.2)
        assert not found() - before and kept[1].count() == 100
    assert spark.conf.get(CLEANUP) == "false"


def test_a_common_line_leaves_once(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("own words of document number "), F.sha1(F.col("id").cast("string")), F.lit(" \nSubscribe to our weekly letter for more news "), F.lpad(F.col("id").cast("string"), 3, "0")).alias("text"))
    got = linededup.line_dedup_table(df).collect()
    assert sorted(r.doc_id for r in got if "Subscribe" in r.text) == [0]


def test_long_lines_have_the_same_simhash(spark):
    line = " ".join(f"w{k * k % 1013}" for k in range(700))
    df = spark.createDataFrame([(line,), ("a b c d e",)], "t string")
    got = [r[0] % 2**64 for r in df.select(linededup.simhash(F.split("t", " "))).collect()]
    assert got == [brute.majority([xxhash.xxh64_intdigest(w.encode(), 42) for w in t.split()]) for t in (line, "a b c d e")]


def test_packed_counts_give_the_same_simhash(spark):
    w = PROSE.split()
    lines = [" ".join(w), " ".join(w[:5]), " ".join(["same"] * 511), " ".join(["same"] * 512), " ".join(f"w{k % 301}" for k in range(511)), " ".join(f"w{k % 301}" for k in range(1300))]
    text = "\n".join(lines)
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, "")], "doc_id long, text string")
    assert linededup.occurrences(df).count() == 3 * len(lines)  # repeated rows are counted apart
    found = linededup.distinct_lines(df)
    norms = {r.id: r.norm for r in found.collect()}
    got = linededup.fingerprinted(found).collect()
    assert len(got) == len(lines) and {r.n for r in found.collect()} == {3}
    for r in got:
        every = brute.normal(norms[r.id])
        taken = [x for x in every if len(x) >= linededup.LETTERS] or every
        assert r.fp % 2**64 == brute.majority([xxhash.xxh64_intdigest(x.encode(), 42) for x in taken])
        assert (r.len, r.words) == (len(norms[r.id]), len(every))
    assert sorted(norms.values()) == sorted(" ".join(brute.normal(x)) for x in lines)


def test_line_codes_keep_edit_distances(spark):
    texts = ["one two three four", "one three four five", "a", "one two two one", "immeasurably one"]
    units = lambda t: [u for u in t.split(" ") for _ in range(-(-len(u) // linededup.UNIT))]
    codes = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(linededup.word_code(F.col("t"))).collect()]
    for t, c in zip(texts, codes, strict=True):
        assert len(c) == len(units(t))
        for u, e in zip(texts, codes, strict=True):
            assert brute.edit_distance(c, e) == brute.edit_distance(units(t), units(u))


def test_thousands_of_near_lines_become_one(spark):
    """One group of near copies of a line, with far more lines than are paired at once, and lines that only share its start."""
    rng = np.random.default_rng(8)
    words = PROSE.split()[:40]
    rows = []
    for k in range(3000):
        own = list(words)
        for at in rng.integers(0, 40, 2):
            own[at] = "".join(chr(97 + x) for x in rng.integers(0, 26, 6))
        rows.append((k, " ".join(own)))
    rows += [(5000 + k, " ".join([*words[:8], *("".join(chr(97 + x) for x in rng.integers(0, 26, 7)) for _ in range(32))])) for k in range(60)]
    got = linededup.line_dedup_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if not r.n_removed} == {0, *range(5000, 5060)}


# --- 8 ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["documents", "edges"])
def test_packing_is_whole_and_exact(request, which):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = request.getfixturevalue(which)
    got = packing.pack_documents(df).collect()
    want = Counter()
    for i, t in ids_and_texts(df):
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        edge = [0, *range(first, len(ids) + 1, 2048)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edge, edge[1:], strict=False)))
    assert bag(r[:5] for r in got) == want
    rows = defaultdict(list)
    for r in got:
        rows[r.sequence_id].append((r.offset, r.length))
    for v in rows.values():
        ends = 0
        for offset, length in sorted(v):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(rows) <= -(-sum(r.length for r in got) // 2048) * 1.06 + 1


def test_plan_pairs_large_items_and_fills_gaps():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = Counter(rng.integers(1, 101, 300).tolist())
        runs = packing.pack_plan(dict(lengths), 100)
        placed, load, large = Counter(), Counter(), Counter()
        order = sorted(runs)
        for k, (length, rank, first, each, offset) in enumerate(order):
            upto = order[k + 1][1] if k + 1 < len(order) and order[k + 1][0] == length else lengths[length]
            for j in range(upto - rank):
                placed[length] += 1
                load[first + j // each] += length
                large[first + j // each] += 3 * length > 100
        assert placed == lengths and max(load.values()) <= 100 and max(large.values()) <= 2
        assert len(load) <= 1.1 * sum(k * v for k, v in lengths.items()) / 100 + 2 or len(load) <= sum(v for k, v in lengths.items() if k > 50) + 2
    with pytest.raises(ValueError):
        packing.pack_plan({101: 1}, 100)


def test_packing_nothing(nothing):
    assert packing.pack_documents(nothing).count() == 0


# --- 9 ------------------------------------------------------------------------------------------------------


def test_decontamination_equals_brute_force(spark, documents, edges, nothing):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text")
    more = [(9001, "mill where farmers bring grain in autumn and children swim"), (9002, "old mill"), (9003, None), (9004, ""), (9000, "old mill"), (9005, " ".join(PROSE.split()[:30]) + " but ends in other words"), (9006, "ünïcode spaces")]
    items = bench.union(spark.createDataFrame(more, "item_id long, text string"))
    pairs = [(r.item_id, r.text) for r in items.collect()]
    docs = documents.select("doc_id", "text").union(edges.select(F.col("doc_id") + 10_000_000, "text"))
    want = brute.contained(ids_and_texts(docs), pairs)
    got = decontam.contained_items(docs, items)
    assert bag(got.select("doc_id", "item_id", "n_shingles", "n_shared").collect()) == bag(want) and len(want) > 10
    left = decontam.drop_contaminated(docs, items)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in ids_and_texts(docs)} - {x[0] for x in want}
    assert decontam.drop_contaminated(edges, items).columns == edges.columns
    assert decontam.contained_items(nothing, items).count() == 0
    assert decontam.contained_items(docs, items.limit(0)).count() == 0
    assert decontam.drop_contaminated(edges, items.limit(0)).count() == edges.count()


# --- 10 -----------------------------------------------------------------------------------------------------


def test_licenses(spark, edges, nothing):
    known = licenses.known_licenses(spark)
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and len(t) > 900)
    changed = "Copyright (c) 2019 Someone\n\n" + mit.upper().replace("LICENSE", "LICENCE").replace(",", " ;")
    texts = [changed, mit + " and more", "Text\nLicensed under the MIT licence!\nReleased under the MIT License.", None, "", "Licensed under CC BY 4.0."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.notices, r.n_notices) for r in licenses.scan_licenses(df, known).collect()}
    assert got[0][0] == "MIT" and got[1][0] is None
    assert got[2] == (None, "MIT", 2) and got[3] == got[4] == (None, "", 0) and got[5] == ("CC-BY-4.0", "CC-BY-4.0", 1)
    twice = licenses.scan_licenses(df.union(df), known).collect()
    assert [got[r.doc_id] for r in twice] == [(r.license_id, r.notices, r.n_notices) for r in twice]
    assert licenses.scan_licenses(edges, known).count() == edges.count() and licenses.scan_licenses(nothing, known).count() == 0
    assert licenses.scan_licenses(df, known.limit(0)).where("license_id is not null").count() == 0
