"""Operator 3, SimHash near-duplicates by a Gray-order hierarchical index.

The upper nodes of the index are masked bit patterns: 64 bits are cut into blocks so that two fingerprints
within the wanted distance agree on all bits of some mask.  Spark deals the distinct fingerprints out by
(mask, pattern); a node with many is split by further masks.  Inside a node they are sorted by Gray rank,
runs of neighbours share masked patterns in nodes above them, and whole runs are pruned when the differences
accumulated on the way down exceed the distance.  Only links that join two parts of a node leave it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import materialize

SEED = 42
SHINGLE = 3
DISTANCE = 3
BITS = 64
#: Children of an index node.
FANOUT = 16
#: Expected fingerprints in an upper node, and the number from which a node is split further.
NODE_ROWS = 64
HOT_ROWS = 16_384
#: Query and node pairs compared at once.
CHUNK = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text; zero for a null text or one without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    h = np.array(hashes, np.uint64)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounds the unpacked bits of very long texts
        part = h[at : at + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of each row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            fp = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(expected: int, distance: int = DISTANCE, within: int = (1 << BITS) - 1) -> list[int]:
    """Masks over the bits ``within``: values at most ``distance`` apart agree on all bits of one mask.

    The bits are cut into n blocks and each mask holds n - distance of them; n grows until a mask has
    bits enough for ``expected`` values at NODE_ROWS a pattern (or there are over 100 masks).
    """
    places = [i for i in range(BITS) if within >> i & 1]
    best: list[int] = []
    for n in range(distance + 1, min(len(places), distance + 6) + 1):
        blocks = [sum(1 << places[i] for i in range(k, len(places), n)) for k in range(n)]
        masks = [sum(c) for c in combinations(blocks, n - distance)]
        if best and len(masks) > 100:
            break
        best = masks
        if expected < NODE_ROWS << min(m.bit_count() for m in masks):
            break
    return best


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The rank of each uint64 in the reflected Gray order."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def build_levels(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index levels above Gray-sorted values, the lowest first: (mask, pattern) of each node.

    A node's mask holds the bits that all its values share, less those its parent holds already.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    levels, mask, pattern = [], np.full(len(fp), full), fp
    while len(mask) > 1:
        starts = np.arange(0, len(mask), FANOUT)
        ones, zeros = np.bitwise_and.reduceat(pattern & mask, starts), np.bitwise_and.reduceat(~pattern & mask, starts)
        shared = ones | zeros
        above = np.repeat(shared, FANOUT)[: len(mask)]
        levels.append((mask & ~above, pattern))
        mask, pattern = shared, ones
    levels.append((mask, pattern))
    return levels


def _near(levels, queries: np.ndarray, first: int, distance: int):
    """Pairs (query index, value index) within ``distance``, the value before the query."""
    q = np.arange(len(queries), dtype=np.int64)
    node, gone = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        mask, pattern = levels[depth]
        gone = gone + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
        near = gone <= distance
        q, node, gone = q[near], node[near], gone[near]
        if depth:
            size = len(levels[depth - 1][0])
            q, gone = np.repeat(q, FANOUT), np.repeat(gone, FANOUT)
            node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            # children that exist and whose first value stands before the query
            ok = (node < size) & (node * FANOUT ** (depth - 1) < q + first)
            q, node, gone = q[ok], node[ok], gone[ok]
    return q + first, node


def node_links(fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the values (distinct uint64) of one upper node: member and its root."""
    fp = fp[np.argsort(gray_rank(fp), kind="stable")]
    n, levels = len(fp), build_levels(fp)
    label = np.arange(n)
    step = max(1, min(n, CHUNK // (FANOUT * max(1, n // 8))))
    for first in range(0, n, step):
        a, b = _near(levels, fp[first : first + step], first, distance)
        while len(a):
            low = np.minimum(label[a], label[b])
            moved = (label[a] != low) | (label[b] != low)
            if not moved.any():
                break
            a, b, low = a[moved], b[moved], low[moved]
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label != (to := label[label])).any():
                label = to
    member = np.flatnonzero(label != np.arange(n))
    return fp[member], fp[label[member]]


def _index_links(batches):
    """Rows sorted by (mask, pattern) in, spanning links out; a node may run over several batches."""
    held: list[np.ndarray] = []
    key = None

    def close():
        fp = np.concatenate(held).view(np.uint64)
        a, b = node_links(fp) if len(fp) > 1 else (fp[:0], fp[:0])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        m, p, fp = (batch.column(c).to_numpy() for c in ("mask", "pattern", "fp"))
        if not len(fp):
            continue
        cuts = np.concatenate([[0], np.flatnonzero((np.diff(m) != 0) | (np.diff(p) != 0)) + 1, [len(fp)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if key is not None and key != (m[a], p[a]):
                if sum(map(len, held)) > 1:
                    yield close()
                held = []
            key = (m[a], p[a])
            held.append(fp[a:b].copy())
    if sum(map(len, held)) > 1:
        yield close()


def _dealt(fps: DataFrame, masks: list[int]) -> DataFrame:
    values = F.array(*[F.lit(_signed(m)) for m in masks])
    return fps.select("fp", F.explode(values).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp")


def near_links(fps: DataFrame, distance: int = DISTANCE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links a, b that connect all values of ``fps`` (distinct longs, column fp) within ``distance``.

    A pattern with over ``hot_rows`` values is split by masks over its other bits until none is left or
    no bits are; nothing is dropped.
    """
    masks = block_masks(fps.count(), distance)
    rows = _dealt(fps, masks)
    ready: DataFrame | None = None
    while True:
        hot = materialize(rows.groupBy("mask", "pattern").count().where(F.col("count") > hot_rows).select("mask", "pattern"), "hot")
        split = [r[0] for r in hot.select("mask").distinct().collect()]  # at most the masks
        fine = {m: f for m in split if len(f := [m | x for x in map(_signed, block_masks(0, distance, ~m & ((1 << BITS) - 1)))]) > 1} if split else {}
        if not fine:
            break
        hot = F.broadcast(hot) if hot.count() <= 10_000 else hot
        keys = ["mask", "pattern"]
        calm = rows.join(hot, keys, "left_anti")
        ready = calm if ready is None else ready.union(calm)
        table = F.create_map(*[x for m, f in fine.items() for x in (F.lit(m), F.array(*map(F.lit, f)))])
        finer = rows.join(hot, keys, "left_semi").select("fp", F.explode(F.coalesce(table[F.col("mask")], F.array("mask"))).alias("mask"))
        rows = materialize(finer.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp").distinct(), "finer")
    rows = rows if ready is None else ready.union(rows)
    sorted_rows = rows.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
    return sorted_rows.mapInArrow(_index_links, "a long, b long")


def simhash_components(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of each document.

    ``docs`` has doc_id and text.  Returns doc_id, fingerprint (16 lowercase hex digits) and component_id: the
    least doc_id that links of at most DISTANCE differing bits reach.  Texts that are null, empty or without
    words have fingerprint zero and link like any other; repeated rows and equal texts share a component; rows
    with a null doc_id get the component of their fingerprint, and a component of such rows alone is null; an
    empty table gives an empty result; other columns are ignored.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(near_links(distinct.select("fp")), "a", "b")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    leads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    lookup = rooted.join(leads, "root").select(F.col("fp").alias("_fp"), "component_id")
    joined = prints.join(lookup, F.col("fp") == F.col("_fp"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its component; all their columns.

    Rows that repeat a doc_id go only where none of their texts leads a component.  Rows with a null doc_id cannot
    be told apart and stay.  The ids that go are joined the same way at every size.
    """
    marked = simhash_components(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("leads"))
    gone = materialize(marked.where("not leads").select(F.col("doc_id").alias("_gone")), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"))
    return rows.join(gone.hint("merge"), F.col("_id") == F.col("_gone"), "left_anti").select("row.*")
