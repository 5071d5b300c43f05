"""Operator 13, phrase collocations from position bitmaps.

Texts are dealt into shards of one language and a few megabytes.  In a shard each frequent word has a compressed bitmap of
its positions (only blocks with a bit are held); a phrase's bitmap, shifted by one and met with a word's by AND, is that
of the phrase with the word after it, and its popcount is the number of occurrences.  Phrases are extended depth first, a batch of first
words at a time; pieces lie one position apart, so no shift leads from one to the next.  Popcounts are summed over shards.
A shard extends only by pairs that are frequent in all shards together; it knows them by a Bloom filter of a fixed size.  Longer phrases
are first summed by hash alone, of three words and then of four and five, in tables of a fixed size; only those whose place there is
frequent are extended and become rows.  Filter and tables let all frequent phrases pass, so that counts stay exact and only the number
of rows to sum depends on them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked
from .store import materialize, small_side

SHARD_BYTES = 2 << 20
#: All open shards of a task together.
OPEN_BYTES = 16 << 20
LEAST = 100
TOP = 2000
MOST_WORDS = 5
#: Bits of a bitmap's block, and entries of a batch of the depth-first search.
BLOCK = 8
BATCH = 1 << 16
#: A filter of frequent phrases: its size, whatever the data, and the bits of a phrase.
FILTER_BITS = 1 << 26
FILTER_HASHES = 4
#: Places of a table that sums phrases by hash, and those of one row of it.
PLACES = 1 << 24
PLACES_ROW = 1 << 12
#: Rows of phrases that a task sums before they leave it.
HELD = 1 << 18
#: A vocabulary within both limits goes to all tasks; a longer one is joined.
SMALL_WORDS, SMALL_BYTES = 200_000, 8 << 20

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK = re.compile(rb"[.,;:!?\n-\r]")
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(_BREAKS)] = 2
_LOW = (1 << 32) - 1


def _words(data: bytes) -> tuple[np.ndarray, pa.Array]:
    """The words of lower-cased bytes: a code for each position, -1 between pieces, and the words by code."""
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.int32), pa.array([], pa.binary())
    piece = np.cumsum(kind == 2)[starts]
    at = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    flat = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes())])
    coded = flat.dictionary_encode()
    stream = np.full(at[-1] + 1, -1, np.int32)
    stream[at] = coded.indices.to_numpy()
    return stream, coded.dictionary


def _sharder(shard_bytes: int):
    """A function that deals (lang, text) rows into shards: shard, lang, n, words, counts and stream (codes by position)."""

    def run(batches):
        names, number, held, size = ["shard", "lang", "n", "words", "counts", "stream"], 0, {}, {}
        prefix = TaskContext.get().partitionId() << 32

        def flush(lang):
            nonlocal number
            data, size[lang] = b"\n".join(held.pop(lang)).lower(), 0
            at = 0
            while at < len(data):  # cut only where a piece ends
                end = _BREAK.search(data, at + shard_bytes) if len(data) - at > shard_bytes else None
                stop = end.end() if end else len(data)
                stream, words = _words(data[at:stop])
                at = stop
                if len(words):
                    number += 1
                    counts = np.bincount(stream[stream >= 0], minlength=len(words))
                    values = [[prefix + number], [lang], [int(counts.sum())], [words.cast(pa.string())], [counts], [stream.tobytes()]]
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                text = text.as_py()
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text) + 1
                if size[lang] >= shard_bytes:
                    yield from flush(lang)
                elif sum(size.values()) >= OPEN_BYTES:
                    yield from flush(max(size, key=size.get))
        for lang in list(held):
            yield from flush(lang)

    return run


class Bitmaps:
    """The compressed position bitmaps of the words of one shard, and their extension to phrases."""

    def __init__(self, ids: np.ndarray):
        at = np.flatnonzero(ids > 0)
        self.names, word = np.unique(ids[at], return_inverse=True)
        self.n, blocks = len(self.names), len(ids) // BLOCK + 2
        key = (at // BLOCK) * max(self.n, 1) + word
        bit = np.left_shift(1, at % BLOCK).astype(np.uint8)
        order = np.argsort(key, kind="stable")
        key, bit = key[order], bit[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        self.bits = np.bitwise_or.reduceat(bit, starts) if len(starts) else bit
        block, self.word = np.divmod(key[starts], max(self.n, 1))
        self.first = np.searchsorted(block, np.arange(blocks + 1))
        by_word = np.argsort(self.word, kind="stable")
        self.of_words = self.word[by_word], block[by_word], self.bits[by_word]
        self.bounds = np.searchsorted(self.of_words[0], np.arange(self.n + 1))

    def batches(self):
        """Bitmaps of runs of words, as (word, block, bits), about BATCH entries at a time."""
        a = 0
        while a < self.n:
            b = max(a + 1, int(np.searchsorted(self.bounds, self.bounds[a] + BATCH, side="right")) - 1)
            yield tuple(x[self.bounds[a] : self.bounds[b]] for x in self.of_words)
            a = b

    def extend(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray):
        """Phrases with one more word: (parent, word, count) of each, and (child, block, bits) of their bitmaps."""
        phrase, block = np.concatenate([phrase, phrase]), np.concatenate([block, block + 1])
        bits = np.concatenate([np.left_shift(bits, 1), np.right_shift(bits, BLOCK - 1)])  # the shift, and what it carries
        some = bits != 0
        phrase, block, bits = phrase[some], block[some], bits[some]
        each = self.first[block + 1] - self.first[block]
        entry = np.repeat(np.arange(len(block)), each)
        other = np.arange(len(entry)) + np.repeat(self.first[block] - (np.cumsum(each) - each), each)
        met = bits[entry] & self.bits[other]
        some = np.flatnonzero(met)
        entry, other, met = entry[some], other[some], met[some]
        key = phrase[entry] * self.n + self.word[other]
        order = np.argsort(key, kind="stable")
        key, met, block = key[order], met[order], block[entry[order]]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.add.reduceat(np.bitwise_count(met).astype(np.int64), starts) if len(starts) else np.empty(0, np.int64)
        parent, word = np.divmod(key[starts], self.n)
        child = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
        return (parent, word, count), (child, block, met)


def _kept(found, bitmap, keep):
    """Children and their bitmaps without those that ``keep`` leaves out."""
    number = np.cumsum(keep) - 1
    child, block, bits = bitmap
    some = keep[child]
    return [x[keep] for x in found], (number[child[some]], block[some], bits[some])


def _pair_rows(batches):
    """Pairs of frequent words in each shard: k1, n."""
    for batch in batches:
        for stream in batch.column("ids").to_pylist():
            maps = Bitmaps(np.frombuffer(stream, np.int32))
            for phrase, block, bits in maps.batches():
                (parent, word, count), _ = maps.extend(phrase, block, bits)
                key = (maps.names[parent].astype(np.int64) << 32) | maps.names[word].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], names=["k1", "n"])


def _places(keys: np.ndarray):
    """The bits of keys in the filter: for each hash, one place of each key."""
    for k in range(1, FILTER_HASHES + 1):
        z = keys.astype(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        yield (z ^ (z >> np.uint64(31))) & np.uint64(FILTER_BITS - 1)


def _filter_key(pair: np.ndarray, third: np.ndarray) -> np.ndarray:
    """What stands for a pair (third word 0) or three words in a filter; unlike ones that agree only pass it."""
    return pair.astype(np.uint64) + third.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def _filter_rows(batches):
    """The filter of a partition's keys, as the 64-bit words of it that have a bit."""
    words = np.zeros(FILTER_BITS // 64, np.uint64)
    for batch in batches:
        for place in _places(_filter_key(batch.column("k1").to_numpy(), batch.column("k2").to_numpy() >> 32)):
            np.bitwise_or.at(words, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
    at = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], names=["at", "bits"])


def _filter(phrases: DataFrame) -> np.ndarray:
    """A Bloom filter of phrases (k1, k2) of two or three words: FILTER_BITS / 8 bytes on the driver, however many there are."""
    found = phrases.select("k1", "k2").mapInArrow(_filter_rows, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.uint64)
    words[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words


def _among(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether keys may be in the filter."""
    some = np.ones(len(keys), bool)
    for place in _places(keys):
        some &= (words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return some


def _phrase_key(k1: np.ndarray, k2: np.ndarray, k3: np.ndarray) -> np.ndarray:
    """What stands for a phrase of four or five words in the table of sums by hash."""
    return _filter_key(k1, k2) + k3.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def _place(keys: np.ndarray) -> np.ndarray:
    """The place of keys in the table of sums by hash."""
    z = (keys ^ (keys >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return (z ^ (z >> np.uint64(29))) & np.uint64(PLACES - 1)


def _longer(pairs, *often):
    """A function over encoded shards: (depth, k1, k2, k3, n) of phrases whose pairs pass a (broadcast) filter, as arrays.

    Without ``often`` those of three words; with the (broadcast) places of three words, those of three to five of which all three
    words in a row are at such a place; with the places of four and five as well, only those that are at such a place.
    """

    def run(batches):
        for batch in batches:
            for stream in batch.column("ids").to_pylist():
                maps = Bitmaps(np.frombuffer(stream, np.int32))
                one = maps.names.astype(np.int64)
                for bitmap in maps.batches():
                    keys = [one << 32, np.zeros(maps.n, np.int64), np.zeros(maps.n, np.int64)]  # of each phrase, packed
                    last, pair = one, None
                    for depth in range(2, (MOST_WORDS if often else 3) + 1):
                        (parent, word, count), bitmap = maps.extend(*bitmap)
                        new = (last[parent] << 32) | one[word]
                        keys = [k[parent] for k in keys]
                        keys[(depth - 1) // 2] |= one[word] << 32 if depth % 2 and depth < 5 else one[word]
                        keep = _among(pairs.value, _filter_key(new, np.zeros(len(new), np.int64)))
                        if often and depth > 2:
                            keep &= _is_often(often[0].value, _filter_key(pair[parent], one[word]))
                        if len(often) > 1 and depth > 3:
                            keep &= _is_often(often[1].value, _phrase_key(*keys))
                        (parent, word, count), bitmap = _kept((parent, word, count), bitmap, keep)
                        if not len(parent):
                            break
                        last, pair, keys = one[word], new[keep], [k[keep] for k in keys]
                        if depth > 2:
                            yield depth, *keys, count

    return run


def _table(longer, depths, least: int):
    """A function over encoded shards: the task's table of sums of phrases of ``depths`` words, each ``least`` at most, as rows at, sums."""
    kind = np.min_scalar_type(least)

    def run(batches):
        table = np.zeros(PLACES, kind)
        for depth, *keys, n in longer(batches):
            if depth in depths:
                place, each = np.unique(_place(_phrase_key(*keys) if depth > 3 else _filter_key(keys[0], keys[1] >> 32)), return_inverse=True)
                table[place] = np.minimum(table[place] + np.bincount(each, n, len(place)).astype(np.int64), least)
        table = table.reshape(-1, PLACES_ROW)
        at = np.flatnonzero(table.any(axis=1))
        for part in np.array_split(at, len(at) // 256 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([table[k].tobytes() for k in part], pa.binary())], names=["at", "sums"])

    return run


def _often_rows(least: int):
    """A function over rows at, sums, all of one at in one task: at and bits, 1 where the sum is ``least`` or more."""
    kind = np.min_scalar_type(least)

    def run(batches):
        tables = {}
        for batch in batches:
            for at, sums in zip(batch.column("at").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                sums = np.frombuffer(sums, kind)
                tables[at] = np.minimum(tables[at] + sums.astype(np.int64), least).astype(kind) if at in tables else sums
        bits = [np.packbits(t >= least).tobytes() for t in tables.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(tables), pa.int64()), pa.array(bits, pa.binary())], names=["at", "bits"])

    return run


def _often(encoded: DataFrame, longer, depths, least: int) -> np.ndarray:
    """A bit for each place, 1 if the phrases there occur ``least`` times together: PLACES / 8 bytes on the driver."""
    sums = encoded.mapInArrow(_table(longer, depths, least), "at long, sums binary")
    found = sums.repartition("at").mapInArrow(_often_rows(least), "at long, bits binary").toArrow()
    table = np.zeros((PLACES // PLACES_ROW, PLACES_ROW // 8), np.uint8)
    for at, bits in zip(found.column("at").to_pylist(), found.column("bits").to_pylist(), strict=True):
        table[at] = np.frombuffer(bits, np.uint8)
    return table.ravel()


def _is_often(often: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether keys are at places whose bit is 1."""
    place = _place(keys)
    return (often[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8) & 1).astype(bool)


def _summed(rows: np.ndarray) -> np.ndarray:
    """Rows k1, k2, k3, n with n summed by k1, k2 and k3."""
    rows = rows[:, np.lexsort(rows[:3])]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(rows[:3]) != 0).any(axis=0)]))
    return np.concatenate([rows[:3, starts], np.add.reduceat(rows[3], starts)[None]])


def _phrase_rows(longer):
    """A function over encoded shards: k1, k2, k3, n of phrases of three words and more, summed over a task's shards up to HELD rows."""

    def run(batches):
        held, size = [], 0
        for _, *found in longer(batches):
            held.append(np.stack(found))
            size += held[-1].shape[1]
            if size > HELD:
                held = [_summed(np.concatenate(held, axis=1))]
                size = held[0].shape[1]
                if size > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["k1", "k2", "k3", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(np.concatenate(held, axis=1))], names=["k1", "k2", "k3", "n"])

    return run


def _encode_rows(batches):
    """The streams of shards with the numbers of frequent words in place of their codes, 0 for all else."""
    for batch in batches:
        out = []
        for stream, codes, numbers, n in zip(batch.column("stream").to_pylist(), batch.column("codes"), batch.column("numbers"), batch.column("n_words").to_pylist(), strict=True):
            table = np.zeros(n + 1, np.int32)  # the last place is that of -1
            table[codes.values.to_numpy()] = numbers.values.to_numpy()
            out.append(table[np.frombuffer(stream, np.int32)].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])


def _coder(vocabulary):
    """A function over shards: their streams with the numbers that a (broadcast) vocabulary, words and numbers by language, gives."""

    def run(batches):
        for batch in batches:
            out = []
            for lang, words, stream in zip(batch.column("lang").to_pylist(), batch.column("words"), batch.column("stream").to_pylist(), strict=True):
                known, numbers = vocabulary.value.get(lang, (pa.array([], pa.string()), np.zeros(0, np.int32)))
                found = pc.index_in(words.values, value_set=known).fill_null(len(known)).to_numpy()
                table = np.append(np.append(numbers, 0)[found], 0).astype(np.int32)  # the last place is that of -1
                out.append(table[np.frombuffer(stream, np.int32)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    return run


def _encoded(shards: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """ids: each shard's positions as numbers of frequent words, 0 for all else; where the vocabulary is small, without a shuffle."""
    known = vocabulary.select("lang", "word", "wid")
    size = vocabulary.agg(F.count("*"), F.sum(F.octet_length("word"))).first()
    if size[0] <= SMALL_WORDS and (size[1] or 0) <= SMALL_BYTES:
        table = known.toArrow()
        langs = table.column("lang").unique().to_pylist()
        mine = lambda lang: table.filter(pc.equal(table.column("lang"), lang))
        held = {lang: (mine(lang).column("word").combine_chunks().cast(pa.string()), mine(lang).column("wid").to_numpy().astype(np.int32)) for lang in langs}
        return shards.select("lang", "words", "stream").mapInArrow(_coder(shards.sparkSession.sparkContext.broadcast(held)), "ids binary")
    used = shards.select("shard", "lang", F.posexplode("words").alias("code", "word")).join(known, ["lang", "word"])
    tables = used.groupBy("shard").agg(F.collect_list(F.struct("code", "wid")).alias("t"))
    tables = tables.select("shard", F.col("t.code").alias("codes"), F.col("t.wid").cast("array<int>").alias("numbers"))
    return shards.select("shard", F.size("words").alias("n_words"), "stream").join(tables, "shard").mapInArrow(_encode_rows, "ids binary")


def _packed(words: list[Column]) -> list[Column]:
    """k1, k2, k3 of up to five word numbers (0: none)."""
    w = [*words, *[F.lit(0).cast("long")] * (MOST_WORDS - len(words))]
    return [(F.shiftleft(w[0], 32) + w[1]), (F.shiftleft(w[2], 32) + w[3]), w[4]]


def _key(words: list[Column]) -> Column:
    return F.struct(*[k.alias(f"k{i + 1}") for i, k in enumerate(_packed(words))])


def _unpacked() -> list[Column]:
    return [F.shiftright("k1", 32), F.col("k1").bitwiseAND(_LOW), F.shiftright("k2", 32), F.col("k2").bitwiseAND(_LOW), F.col("k3")]


def phrase_counts(docs: DataFrame, least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(totals, vocabulary, phrases) of ``docs`` (lang, text): all phrases of one to five words with ``least`` occurrences in their language.

    Totals has lang and n (all words), vocabulary lang, word, f and wid (a number of its own for each word of each language), phrases k1, k2,
    k3 (word numbers, two in a long), size (words) and f.
    """
    shards = materialize(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_sharder(shard_bytes), "shard long, lang string, n long, words array<string>, counts array<long>, stream binary"), "shards")
    totals = materialize(shards.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    counted = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("p")).groupBy("lang", F.col("p.words").alias("word")).agg(F.sum("p.counts").alias("f"))
    frequent = materialize(counted.where(F.col("f") >= least).withColumn("every", F.lit(0)), "frequent")
    vocabulary = materialize(ranked(frequent, "every", ["lang", "word"], "place").select("lang", "word", "f", (F.col("place") + 1).cast("long").alias("wid")), "vocabulary")

    encoded = materialize(_encoded(shards, vocabulary), "encoded")

    pairs = encoded.mapInArrow(_pair_rows, "k1 long, n long").groupBy("k1").agg(F.sum("n").alias("f"))
    two = materialize(pairs.where(F.col("f") >= least), "two")
    none = F.lit(0).cast("long")
    send = shards.sparkSession.sparkContext.broadcast
    in_pairs = send(_filter(two.withColumn("k2", none)))
    three = send(_often(encoded, _longer(in_pairs), (3,), least))
    four = send(_often(encoded, _longer(in_pairs, three), (4, 5), least))
    rows = encoded.mapInArrow(_phrase_rows(_longer(in_pairs, three, four)), "k1 long, k2 long, k3 long, n long")
    longer = rows.groupBy("k1", "k2", "k3").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    ones = vocabulary.select(F.shiftleft("wid", 32).alias("k1"), none.alias("k2"), none.alias("k3"), "f")
    every = ones.unionByName(two.select("k1", none.alias("k2"), none.alias("k3"), "f")).unionByName(longer)
    size = sum((F.when(w != 0, 1).otherwise(0) for w in _unpacked()), F.lit(0))
    return totals, vocabulary, materialize(every.select("k1", "k2", "k3", size.alias("size"), "f"), "phrases")


def _whole(phrases: DataFrame) -> DataFrame:
    """The candidates without those that a longer one holds as often as they occur.

    A phrase that any longer candidate holds without loss is held so by one with a single word more, as the
    phrases between the two occur as often.
    """
    w = _unpacked()
    parts = lambda n: [_key(w[1:n]), _key(w[: n - 1])]
    held = F.when(F.col("size") == 3, F.array(*parts(3))).when(F.col("size") == 4, F.array(*parts(4))).otherwise(F.array(*parts(5)))
    inner = phrases.where("size >= 3").select(F.explode(held).alias("h"), "f").groupBy(*[F.col(f"h.k{i}").alias(f"h{i}") for i in (1, 2, 3)]).agg(F.max("f").alias("longer"))
    met = phrases.where("size >= 2").join(inner, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")) & (F.col("k3") == F.col("h3")), "left")
    return met.where(F.col("longer").isNull() | (F.col("longer") < F.col("f"))).select("k1", "k2", "k3", "size", "f")


def _scored(candidates: DataFrame, phrases: DataFrame, vocabulary: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, k1, k2, k3, size, a, l, r, n and score: the lowest score of all cuts, of equal ones that of the fewest words before the cut."""
    w = _unpacked()
    cut = lambda n, k: F.struct(F.lit(k).alias("k"), _key(w[:k]).alias("x"), _key(w[k:n]).alias("y"))
    cuts = F.coalesce(*[F.when(F.col("size") == n, F.array(*[cut(n, k) for k in range(1, n)])) for n in range(2, MOST_WORDS + 1)])
    rows = candidates.select("k1", "k2", "k3", "size", F.col("f").alias("a"), F.explode(cuts).alias("c"))
    for side, name in (("x", "l"), ("y", "r")):
        part = phrases.select(*[F.col(f"k{i}").alias(f"{side}{i}") for i in (1, 2, 3)], F.col("f").alias(name))
        rows = rows.join(part, (F.col(f"c.{side}.k1") == F.col(f"{side}1")) & (F.col(f"c.{side}.k2") == F.col(f"{side}2")) & (F.col(f"c.{side}.k3") == F.col(f"{side}3")))
    langs = vocabulary.select(F.col("wid"), "lang")
    rows = rows.join(langs, F.shiftright("k1", 32) == F.col("wid")).join(small_side(totals), "lang")
    dec = lambda c, p: F.col(c).cast(f"decimal({p},0)")
    # At most 4 + 15 + 17 digits above the line and 34 below: exact in decimals.
    score = F.call_function("div", dec("a", 15) * F.lit(1000).cast("decimal(4,0)") * dec("n", 17), dec("l", 17) * dec("r", 17))
    rows = rows.select("lang", "k1", "k2", "k3", "size", "a", "n", F.struct(score.alias("score"), F.col("c.k").alias("k"), "l", "r").alias("s"))
    return rows.groupBy("lang", "k1", "k2", "k3", "size", "a", "n").agg(F.min("s").alias("s")).select("lang", "k1", "k2", "k3", "size", "a", "s.l", "s.r", "n", "s.score")


def _first(rows: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The first rows of each language with their rank, taken in parts first, so that no task meets a whole language."""
    spread = F.pmod(F.xxhash64("k1", "k2", "k3"), F.lit(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    some = rows.withColumn("part", spread).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("part")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The phrases of two to five words that stick together most, for each language.

    ``docs`` has lang and text.  Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words at blanks and
    tabs.  Candidates occur ``least`` times or more; of a candidate that occurs a times, in a language of n words, cut into two
    parts that occur l and r times, the score is floor(1000 * a * n / (l * r)), of all cuts the lowest.  Candidates that a longer one
    holds as often are dropped.  Returns the first ``top`` of each language by score, a (both descending) and phrase: lang,
    rank, phrase, a, l, r, n, score.

    A null lang is ``und``; null and empty texts have no words; repeated rows count each; texts of any length are cut where pieces end;
    an empty table gives an empty result; other columns are ignored.
    """
    totals, vocabulary, phrases = phrase_counts(docs, least, shard_bytes)
    scored = materialize(_scored(_whole(phrases), phrases, vocabulary, totals), "scored")
    # The last place by numbers alone says how far down words are needed; ties there all stay.
    order = [F.col("score").desc(), F.col("a").desc()]
    last = _first(scored.select("lang", "k1", "k2", "k3", "score", "a"), order, top).where(F.col("rank") == top)
    last = materialize(last.select(F.col("lang").alias("t_lang"), F.struct("score", "a").alias("floor")), "floors")
    near = scored.join(small_side(last), F.col("lang") == F.col("t_lang"), "left").where(F.col("floor").isNull() | (F.struct("score", "a") >= F.col("floor")))
    near = materialize(near.drop("t_lang", "floor"), "near")
    spelt = near.select("k1", "k2", "k3", F.posexplode(F.filter(F.array(*_unpacked()), lambda x: x != 0)).alias("i", "wid")).join(vocabulary.select("wid", "word"), "wid")
    spelt = spelt.groupBy("k1", "k2", "k3").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("w")).select("k1", "k2", "k3", F.concat_ws(" ", "w.word").alias("phrase"))
    out = _first(near.join(spelt, ["k1", "k2", "k3"]), [*order, F.col("phrase")], top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
