"""Operator 9, benchmark decontamination: size-partitioned MinHash containment search.

A document's sketch keeps the least shingle hash of each of many bins; documents are partitioned by size, and
the number of bins follows the partition, so that a short item inside a long document still meets the sketch.
Items are partitioned by size as well: the fewer shingles an item has, the finer the bins it is searched with,
until the chance of missing a true item is below MISS.  Candidates are verified by exact shingle containment.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, small_side

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-9
#: Bins for each shingle of a full size partition, as powers of two; then every shingle has a bin of its own.
FINENESS = (0, 2, 4, 8)
#: Bytes of item texts searched in one pass over the documents.
BLOCK_BYTES = 16 << 20

#: ASCII bytes other than letters and digits part words; all other bytes belong to them.
_SPACES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words in lower case (UTF-8), parted by ASCII characters other than letters and digits."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()


def shingles(tokens: list[bytes], size: int) -> list[bytes]:
    """All runs of ``size`` words, joined by single spaces; none if there are fewer words."""
    if len(tokens) < size:
        return []
    line, lengths = b" ".join(tokens), np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - size + 1].tolist()
    return [line[a:b] for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]


def needed(n: int) -> int:
    """The least number of an item's n shingles that counts as contained."""
    return max(1, math.ceil(CONTAINMENT * n - 1e-9))


def fineness(n: int) -> int | None:
    """The least fineness that finds an item of n shingles with a chance of missing it below MISS; None: all."""
    for fine in FINENESS:
        load = 2.0**-fine
        hit = (1 - math.exp(-load)) / load  # chance that a given shingle is least in its bin
        if (1 - hit) ** needed(n) <= MISS:
            return fine
    return None


class Searcher:
    """Items of one block, indexed by shingle length and fineness."""

    def __init__(self, items: list[tuple[int, str]]):
        self.sets: list[tuple[int, int, set[bytes]]] = []
        parts: dict[tuple[int, int | None], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            tokens = words(text)
            size = min(SHINGLE, len(tokens))
            if size:
                own = set(shingles(tokens, size))
                for s in own:
                    parts[size, fineness(len(own))][xxhash.xxh64_intdigest(s)].append(len(self.sets))
                self.sets.append((item, size, own))
        self.parts = {k: (np.sort(np.fromiter(v, np.uint64, len(v))), v) for k, v in parts.items()}
        self.sizes = sorted({size for size, _ in self.parts})

    def find(self, text: str | None):
        """(item, its shingles, those contained) of each item that the text contains."""
        tokens = words(text)
        for size in self.sizes:
            own = shingles(tokens, size)
            if not own:
                continue
            hashes = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own)))
            found: set[int] = set()
            bits = (len(hashes) - 1).bit_length()  # the size partition
            for (other, fine), (known, where) in self.parts.items():
                if other == size:
                    sketch = hashes if fine is None or bits + fine > 63 else _least(hashes, bits + fine)
                    at = np.minimum(np.searchsorted(known, sketch), len(known) - 1)
                    for h in sketch[known[at] == sketch].tolist():
                        found.update(where[h])
            if found:
                held = set(own)
                for k in found:
                    item, _, wanted = self.sets[k]
                    shared = len(wanted & held)
                    if shared >= needed(len(wanted)):
                        yield item, len(wanted), shared


def _least(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The least of the sorted hashes in each of 2^bits equal ranges."""
    if not bits:
        return hashes[:1]
    bins = hashes >> np.uint64(64 - bits)
    return hashes[np.concatenate([[True], bins[1:] != bins[:-1]])]


def contained_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Which items (item_id, text) each document (doc_id, text) contains.

    Returns doc_id, item_id, n_shingles, n_shared: a row where a document holds at least CONTAINMENT of an item's
    distinct shingles of SHINGLE words (of an item with fewer words: of its whole word sequence).  Items equal in
    text are one, named by the least item_id; items without words, and null texts, match nothing; repeated
    documents give repeated rows; empty tables give an empty result; other columns are ignored.  Items are
    searched in blocks of BLOCK_BYTES, one pass over the documents for each block.
    """
    return _contained(docs.select(F.col("doc_id").cast("long"), "text"), items)


def _contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """:func:`contained_items` with a doc_id of any type."""
    distinct = items.where("text is not null").groupBy("text").agg(F.min("item_id").cast("long").alias("item_id"))
    distinct = materialize(distinct.select("item_id", "text"), "items")
    total = distinct.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    out = None
    for k in range(blocks):
        block = [tuple(r) for r in distinct.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()]
        found = _search(docs, block)
        out = found if out is None else out.union(found)
    return out


def _search(docs: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most about BLOCK_BYTES
    types = [pa.string() if dict(docs.dtypes)["doc_id"] == "string" else pa.int64(), *[pa.int64()] * 3]

    def run(batches):
        search = Searcher(shared.value)
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for hit in search.find(text.as_py())]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "n_shingles", "n_shared"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, n_shingles long, n_shared long")


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item; all their columns.

    Rows are judged by their text alone, so that repeated or null ids do not matter; hits are known by the text's
    length and MD5, of which two texts do not agree by chance.
    """
    key = F.concat_ws("-", F.octet_length("text").cast("string"), F.md5("text"))
    hits = materialize(_contained(docs.select(key.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_hit")).distinct(), "hits")
    rows = docs.select(F.struct("*").alias("row"), key.alias("_key"))
    return rows.join(small_side(hits), F.col("_key") == F.col("_hit"), "left_anti").select("row.*")
