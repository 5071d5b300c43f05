"""Operator 8, best-fit packing of tokenised documents by large-item matching.

Spark tokenises the documents and counts the pieces of each length.  That histogram, of at most as many rows as
a sequence has tokens, is all that the driver sees: on it, pieces over one third of the capacity are matched at
most two to a sequence, and smaller ones fill the tightest gaps.  The plan is a list of runs of equal pieces;
each piece finds its run by its rank among the pieces of its length, so that the packing is one for the whole
corpus while no task holds more than its share.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ranked
from .store import materialize

CAPACITY = 2048
END_ID = 0
#: Texts of characters below this go through the faster of two libraries with the same vocabulary; both agree
#: there, while their tables of newer Unicode characters may not.
COMMON = "ɐ"
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def _encoders(vocabulary: str, ranks: str | None):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    if ranks is None:
        return exact, None
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return exact, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def encode(text: str | None, vocabulary: str, ranks: str | None) -> np.ndarray:
    """The ids of a text, as tokenizers gives them without special tokens, and END_ID."""
    text = text or ""
    exact, fast = _encoders(vocabulary, ranks)
    if fast is not None and SPECIAL not in text and (text.isascii() or max(text) < COMMON):
        ids = fast.encode_ordinary(text)
    else:
        ids = exact.encode(text, add_special_tokens=False).ids
    return np.array([*ids, END_ID], "<u4")


def default_vocabulary() -> tuple[str, str]:
    """Paths of the byte-level BPE vocabulary and of the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of each document.

    A document longer than ``capacity`` is cut so that only its first piece may be shorter than that.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if with_ids else []

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py(), vocabulary, ranks)
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    part = ids[a:b]
                    out.append((doc, k, a, b - a, zlib.crc32(part.tobytes()), *([part.astype("<i4")] if with_ids else [])))
            columns = list(zip(*out, strict=True)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def pack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, pieces in each sequence, offset in it).

    Works on groups of sequences with equal gaps, never on single pieces.
    """
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    runs: list[tuple[int, int, int, int, int]] = []
    placed = dict.fromkeys(counts, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    opened = 0

    def open_group(n: int) -> int:
        nonlocal opened
        opened += n
        return opened - n

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps.get(gap):
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    def put(length: int, first: int, n: int, each: int, gap: int) -> int:
        """``each`` pieces into n sequences with this gap; the gap that is left."""
        runs.append((length, placed[length], first, each, capacity - gap))
        placed[length] += n * each
        return gap - each * length

    left = dict(counts)
    large = sorted(n for n in counts if 3 * n > capacity and counts[n])
    while large:
        top = large[-1]
        at = bisect_left(large, capacity - top + 1) - 1
        mate = large[at] if at >= 0 else None
        if mate == top and left[top] == 1:
            mate = large[at - 1] if at > 0 else None
        n = left[top] if mate is None else left[top] // 2 if mate == top else min(left[top], left[mate])
        first = open_group(n)
        gap = put(top, first, n, 1, capacity)
        left[top] -= n
        if mate is not None:
            gap = put(mate, first, n, 1, gap)
            left[mate] -= n
        leave(gap, first, n)
        large = [x for x in large if left[x]]
    for length in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(order, length)
            if at == len(order):
                gap, each = capacity, capacity // length
                n = max(1, left[length] // each)
                first = open_group(n)
            else:
                gap = order[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    order.pop(at)
                each = gap // length
            full = min(n, left[length] // each)
            if not full:
                full, each = 1, left[length]
            left[length] -= full * each
            leave(gap, first + full, n - full)
            leave(put(length, first, full, each, gap), first, full)
    return runs


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """The place of each piece of each document in sequences of at most ``capacity`` tokens.

    ``docs`` has doc_id and text; ``vocabulary`` is a tokenizers file, ``ranks`` the same vocabulary for the
    faster library (None: only tokenizers is used); both None: :func:`default_vocabulary`.  Returns doc_id,
    piece, start, length, ids_crc32, sequence_id, offset, and ids with ``with_ids``.  A null or empty text is the
    end token alone; repeated rows are packed once each; rows with a null doc_id are packed like others; an empty
    table gives an empty result; other columns are ignored.
    """
    if vocabulary is None:
        vocabulary, ranks = default_vocabulary()
    # Written first: the sort by range samples its input, and would tokenise all texts a second time.
    made = materialize(pieces(docs, vocabulary, ranks, capacity, with_ids), "pieces")
    cut = ranked(made, "length", ["doc_id", "piece"], "rank")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = np.array(sorted(pack_plan(counts, capacity)), np.int64).reshape(-1, 5)
    # Runs by (length, first rank) in one sorted key; ranks stay below 2^50.
    keys = (plan[:, 0] << 50) + plan[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = np.searchsorted(keys, (length << 50) + rank, side="right") - 1
            local = rank - plan[run, 1]
            sequence, offset = plan[run, 2] + local // plan[run, 3], plan[run, 4] + local % plan[run, 3] * length
            names = [n for n in batch.schema.names if n != "rank"]
            arrays = [batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return cut.mapInArrow(place, schema)
