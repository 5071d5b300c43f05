"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; each round is written to the shared folder, and the one before it
deleted.  Nothing is collected: the driver only sees counts and a checksum, and compares the edges themselves
where these agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, materialize

#: Rounds needed grow with the logarithm of the longest chain; this stops only on a defect.
MAX_ROUNDS = 60


def _signature(edges: DataFrame):
    low = F.xxhash64("u", "v").bitwiseAND(F.lit(0x3FFFFFFF))
    return edges.agg(F.count("*"), F.sum(low)).first()


def _same(one: DataFrame, two: DataFrame) -> bool:
    """Whether two sets of edges of the same size are equal."""
    return not one.join(two, ["u", "v"], "left_anti").limit(1).count()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("w"))
    joined = edges.join(least, "u")
    moved = joined.where("v <> w").select(F.col("v").alias("u"), F.col("w").alias("v"))
    return moved.union(least.select("u", F.col("w").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` of every node that has an edge; root is the least node of its component.

    Nulls and loops are ignored, repeated edges count once; an empty table gives an empty result.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    held = Scratch(edges.sparkSession, "edges")
    current = held.keep(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _signature(current)
    for _ in range(MAX_ROUNDS if seen[0] else 0):
        ahead = Scratch(edges.sparkSession, "edges")
        after = ahead.keep(_small_star(_large_star(current)), "edges")
        now = _signature(after)
        settled = now == seen and _same(after, current)
        held.clear()
        held, current, seen = ahead, after, now
        if settled:
            break
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    roots = current.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    out = materialize(current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), "roots")
    held.clear()
    return out
