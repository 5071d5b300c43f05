"""Operator 6, sharding: rendezvous hashing of stable record keys over weighted shards.

Built-in SQL functions only.  A record goes to the shard with the highest score
``ln(u) / weight``, where u in (0, 1) comes from a hash of key and shard; a shard that is added takes
records only into itself, one that is removed gives up only its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import ranked
from .store import let

#: 53 bits of the hash make u: all doubles involved are exact.
_UNIT = float(1 << 53)


def key_hash(docs: DataFrame, name: str) -> Column:
    """The hash of a key column; equal ids hash alike whatever type holds them.

    Whole numbers that fit a long hash as one, whether they come as a number or as its decimal text; all else hashes
    as text.  A null hashes as the seed alone.
    """
    kind, key = docs.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.xxhash64(key.cast("long"))
    text = key.cast("string")
    whole = key.try_cast("long") if isinstance(kind, T.NumericType) else text.try_cast("long")
    same = whole == key if isinstance(kind, T.NumericType) else whole.cast("string") == text
    return F.when(same, F.xxhash64(whole)).otherwise(F.xxhash64(text))


def rendezvous(key: Column, weights: list[float], hashed: bool = False) -> Column:
    """The shard (0 to len(weights) - 1) of a key, or of its hash.

    Ties go to the higher shard; a null key hashes as the seed alone, so all null keys share a shard.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive and at least one")
    return let(key if hashed else F.xxhash64(key), lambda base: _best(base, weights))


def _best(base: Column, weights: list[float]) -> Column:
    table = F.array(*[F.lit(float(w)) for w in weights])
    scores = F.transform(
        F.sequence(F.lit(0), F.lit(len(weights) - 1)),
        lambda s: F.struct(
            (F.ln((F.shiftrightunsigned(F.xxhash64(base, s.cast("long")), 11).cast("double") + 0.5) / _UNIT) / F.get(table, s)).alias("score"),
            s.alias("shard"),
        ),
    )
    return F.array_max(scores)["shard"]


def shard_documents(docs: DataFrame, weights: list[float], grown: list[float] | None = None) -> DataFrame:
    """Shards, sizes, checksums and gapless slots of all documents.

    ``docs`` has doc_id and text.  Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32,
    law ('key'), shard, slot (0, 1, 2, ... in a shard, by doc_id, checksum and size) and grown_shard (the
    shard under the weights ``grown``, null without them).  A null text counts as empty; repeated rows go
    to one shard and get a slot each; an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = key_hash(docs, "doc_id")
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(base, weights, True).cast("int").alias("shard"),
        (rendezvous(base, grown, True) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    )
    out = ranked(rows, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
