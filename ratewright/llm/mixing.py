"""Operator 12, mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Built-in SQL functions only.  Sources share a total by weight; a source whose share is above its most epochs is clamped
there, and what it cannot take is dealt to the others by weight, until none is above.  A document then goes in as often
as its source has whole epochs; of the fraction that is left, a source takes its documents in a seeded order until it is
filled.  No sort over all rows and no window over a whole source: sums of the cells of the seeded order name the one cell in which
a source's fraction ends, each time 4,096 times finer, and only the few documents of that cell are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked
from .store import materialize, small_side

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits by which a cell is divided each time.
DIGITS = 3
#: A cell with at most this many rows is ordered row by row.
LEAF_ROWS = 1024
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, weights: list[float]) -> DataFrame:
    """``sources`` (a column source, each once) with weight: by code point, null last, the weights in turn."""
    keyed = sources.select("source", F.col("source").isNull().alias("none"), F.lit(0).alias("every"))
    placed = ranked(keyed, "every", ["none", "source"], "place")
    table = F.array(*[F.lit(float(w)) for w in weights])
    return placed.select("source", F.get(table, (F.col("place") % len(weights)).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, total: float, epochs: float) -> DataFrame:
    """``sources`` (source, weight, source_size) with target.

    ``total`` is shared by weight; a target stops at ``epochs`` times its source's size, and the excess is shared by weight
    among the others until none is above.  If all are clamped, what is left of the total goes to nobody.  Each round is
    one aggregate over the sources, of which two sums reach the driver.
    """
    cap = F.col("source_size") * float(epochs)
    share = 0.0
    while True:
        above = cap < F.col("weight") * share
        held = F.sum(F.when(above, cap).otherwise(0.0))
        free = F.sum(F.when(above, 0.0).otherwise(F.col("weight")))
        row = sources.agg(held.alias("held"), free.alias("free")).first()
        level = max(total - (row.held or 0.0), 0.0) / row.free if row.free else share
        if level <= share:
            break
        share = level
    return sources.withColumn("target", F.least(cap, F.col("weight") * share))


def _cells(rows: DataFrame, state: DataFrame, digits: int) -> DataFrame:
    """For each source of ``state``: the next finer cell in which its fraction ends, and the sizes before it."""
    mine = rows.join(small_side(state), rows["source"].eqNullSafe(state["s_source"]))
    mine = mine.where(F.substring("key", 1, digits - DIGITS) == F.col("cell"))
    sums = mine.groupBy("s_source", "extra", "before", F.substring("key", 1, digits).alias("next")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    upto = Window.partitionBy("s_source").orderBy("next")  # at most 4,096 cells
    ends = sums.withColumn("end", F.col("before") + F.sum("size").over(upto)).withColumn("last", F.row_number().over(upto))
    # Rounding may put the end of a fraction beyond the last cell; that cell then holds it.
    key = F.struct((F.col("end") < F.col("extra")).alias("short"), F.when(F.col("end") < F.col("extra"), -F.col("last")).otherwise(F.col("last")).alias("at"))
    found = ends.groupBy("s_source", "extra").agg(F.min_by(F.struct("next", (F.col("end") - F.col("size")).alias("before"), "n"), key).alias("c"))
    return found.select("s_source", "extra", F.col("c.next").alias("cell"), F.col("c.before").alias("before"), F.col("c.n").alias("n"))


def _fraction_ends(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source, the cell of the seeded order in which its fraction ends: s_source, extra, cell, before, n."""
    state = plan.select(F.col("source").alias("s_source"), "extra", F.lit("").alias("cell"), F.lit(0).cast("long").alias("before"), "n")
    digits = 0
    while True:
        coarse = state.where(F.col("n") > LEAF_ROWS)
        if digits >= 64 or coarse.isEmpty():
            return state
        digits += DIGITS
        finer = _cells(rows, coarse, digits)
        state = materialize(state.where(F.col("n") <= LEAF_ROWS).unionByName(finer), "cells")


def mix(docs: DataFrame, weights: DataFrame | list[float], epochs: float = 3.0, seed: str = SEED) -> DataFrame:
    """What a mix of the sources by weight takes of each document.

    ``docs`` has doc_id, source and text; ``weights`` has source and weight (positive; a source that it lacks takes part in
    nothing), or is a list that the sources get in turn, by code point, null last.  Returns doc_id, size (words), source_size,
    target (of its source; all targets sum to all sizes) and taken (size times the repetitions).  Of a source, the words taken
    differ from the target by at most half a document, that in which its fraction ends.

    Null texts have no words and take nothing; null sources are one source, null ids allowed; equal rows are told apart by
    their place in the written table; a source without words has the target 0; an empty table gives an empty result; other
    columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")), "sized")
    # Only rows equal in id and text share a key; their places in the written table tell them apart.
    place = F.md5(F.concat_ws("|", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")).cast("binary"))
    rows = sized.select("doc_id", "source", "size", F.concat("key", place).alias("key"))

    sums = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sums")
    if isinstance(weights, list):
        weights = cycled_weights(sums, weights)
    weighed = materialize(sums.join(weights.select(F.col("source").alias("w_source"), "weight"), F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source").fillna(0.0, ["weight"]), "weighed")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = water_fill(weighed, float(total), epochs).withColumn("whole", whole)
    plan = materialize(plan.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "plan")

    ends = _fraction_ends(rows, plan)
    full = materialize(plan.drop("n", "extra").join(ends.drop("n"), F.col("source").eqNullSafe(F.col("s_source"))).drop("source"), "mixed")
    held = rows.join(small_side(full), F.col("source").eqNullSafe(F.col("s_source")))
    at = F.substr("key", F.lit(1), F.length("cell"))
    out = lambda df, more: df.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + more)).alias("taken"))
    apart = out(held.where(at != F.col("cell")), F.when(at < F.col("cell"), 1).otherwise(0))
    # A cell has few rows: the sizes before each are summed in one window.
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("s_source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = held.where(at == F.col("cell")).withColumn("ahead", F.col("before") + ahead)
    return apart.unionByName(out(inside, F.when(2 * F.col("ahead") + F.col("size") <= 2 * F.col("extra"), 1).otherwise(0)))
