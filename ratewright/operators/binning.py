"""Border grids from distinct values: midpoints, weighted quantiles, rare bins."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bin_index, missing
from .ordered import running


def distinct_values(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """v, w, n: total weight and rows of each distinct non-missing value (as float)."""
    v = F.col(value).cast("float")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.where(~missing(v)).groupBy(v.alias("v")).agg(F.sum(w).alias("w"), F.count("*").alias("n"))


def midpoint_borders(df: DataFrame, value: str) -> DataFrame:
    """border: one between each two neighbouring distinct values.

    The midpoint is taken in double and rounded to float; where it rounds up to the higher value, the lower
    value separates them.  The window runs over distinct values, so use it on columns with few of them.
    """
    order = Window.orderBy("v")
    rows = distinct_values(df, value).withColumn("next", F.lead("v").over(order)).where("next is not null")
    mid = ((F.col("v").cast("double") + F.col("next").cast("double")) / 2).cast("float")
    return rows.select(F.when(mid >= F.col("next"), F.col("v")).otherwise(mid).alias("border"))


def value_sums(df: DataFrame, value: str, weight: str) -> DataFrame:
    """v, w, rank and cum_w of the distinct values in order; written once, so that grids may read it often."""
    return running(distinct_values(df, value, weight).select("v", "w"), [F.col("v").asc()], ["w"])


def quantile_borders(df: DataFrame, value: str, weight: str, max_bin: int, sums: DataFrame | None = None) -> DataFrame:
    """border: the distinct weighted quantiles at i / max_bin, i from 1 to max_bin - 1.

    A quantile is the least value whose cumulative weight reaches its share.  ``sums`` are :func:`value_sums` of the column.
    """
    rows = value_sums(df, value, weight) if sums is None else sums
    total = rows.agg(F.max("cum_w").alias("total"))  # one row
    placed = rows.join(F.broadcast(total))
    target = lambda i: i / F.lit(max_bin) * F.col("total")
    past = F.col("cum_w") - F.col("w")
    near = F.floor(past / F.col("total") * max_bin)
    hit = F.lit(False)
    for step in (0, 1, 2):  # the next share above the rows before, and one on either side against rounding
        i = near + step
        hit = hit | ((i >= 1) & (i < max_bin) & (target(i) <= F.col("cum_w")) & (target(i) > past))
    # A heavy value may pass several shares; the first of them is tried.
    return placed.where(hit).select(F.col("v").alias("border"))


def separating_border(low: float, high: float) -> float:
    """The midpoint of two neighbouring values as a float, or the lower one where it rounds up to the higher."""
    mid = np.float32((float(np.float32(low)) + float(np.float32(high))) / 2)
    return float(np.float32(low) if mid >= np.float32(high) else mid)


def refill_borders(df: DataFrame, value: str, weight: str, borders: list[float], max_bin: int, sums: DataFrame | None = None) -> list[float]:
    """``borders`` and more, up to ``max_bin`` - 1, where heavy values have left some unused.

    Each time, of the intervals with two values or more, the heaviest (of equal ones the lowest) is parted where its weight is
    halved: after the first value up to which half of it lies, but before its last.  Running sums of the distinct values are
    written once; each job finds the places for all intervals that are new, and hands a row for each to the driver, where a heap
    takes the heaviest until it meets one without a place.
    """
    wanted = max_bin - 1 - len(borders)
    if wanted <= 0:
        return list(borders)
    rows = value_sums(df, value, weight) if sums is None else sums
    out = sorted(float(np.float32(b)) for b in borders)
    inner = F.lit(0) if not out else bin_index(F.col("v"), out) - 1
    found = rows.groupBy(inner.alias("k")).agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.min(F.col("cum_w") - F.col("w")).alias("start"), F.max("cum_w").alias("end")).collect()
    heap = [(-(r["end"] - r["start"]), r["lo"], r["hi"], r["start"], r["end"]) for r in found if r["hi"] > r["lo"]]
    heapq.heapify(heap)
    places: dict[int, tuple[int, float, float, float]] = {}
    while heap and wanted:
        if heap[0][1] not in places:
            places |= _halves(rows, [x for x in heap if x[1] not in places])
        _, lo, hi, start, end = heapq.heappop(heap)
        rank, low, high, cut = places.pop(lo)
        out.append(separating_border(low, high))
        wanted -= 1
        for a, b, x, y in ((lo, rank, start, cut), (rank + 1, hi, cut, end)):
            if b > a:
                heapq.heappush(heap, (-(y - x), a, b, x, y))
    return sorted(set(out))


def _halves(rows: DataFrame, intervals: list[tuple]) -> dict[int, tuple[int, float, float, float]]:
    """For each interval, by its first rank: rank and value after which it is parted, the next value, and the sum up to there."""
    spark = rows.sparkSession
    found = spark.createDataFrame([(lo, hi, start + (end - start) * 0.5) for _, lo, hi, start, end in intervals], "lo long, hi long, half double")
    # At most as many as there are bins; a value lies in one of them at most.
    ordered = sorted((lo, hi) for _, lo, hi, *_ in intervals)
    starts = F.array(*[F.lit(lo) for lo, _ in ordered])
    at = F.aggregate(starts, F.lit(None).cast("long"), lambda last, x: F.when(x <= F.col("rank"), x).otherwise(last))
    met = rows.withColumn("mine", at).join(F.broadcast(found), F.col("mine") == F.col("lo")).where(F.col("rank") <= F.col("hi"))
    before = F.col("cum_w") - F.col("w")
    past = (F.col("cum_w") >= F.col("half")) | (F.col("rank") == F.col("hi") - 1)
    cut = F.min(F.when(past & (F.col("rank") < F.col("hi")), F.struct("rank", "v", "cum_w")))
    after = F.min(F.when((F.col("rank") > F.col("lo")) & ((before >= F.col("half")) | (F.col("rank") == F.col("hi"))), F.struct("rank", "v")))
    return {r["lo"]: (r["cut"]["rank"], r["cut"]["v"], r["after"]["v"], r["cut"]["cum_w"]) for r in met.groupBy("lo").agg(cut.alias("cut"), after.alias("after")).collect()}


def collapse_rare(borders: list[float], counts: list[int], least: int) -> list[float]:
    """Borders without those that close a bin of fewer than ``least`` rows; counts are of bins 1, 2, ..."""
    kept, held = [], 0
    for border, n in zip(borders, counts, strict=False):
        held += n
        if held >= least:
            kept.append(border)
            held = 0
    if kept and sum(counts[len(borders) :]) + held < least:
        kept.pop()
    return kept


def weighted_quantiles(df: DataFrame, value: str, weight: str, shares: list[float]) -> DataFrame:
    """share, value: the least value whose cumulative weight reaches each share of the total.

    Where it reaches the share exactly, the border between that value and the next one above: their midpoint as a
    float, or the lower value where that rounds up to the higher.
    """
    rows = running(distinct_values(df, value, weight).where("w > 0"), [F.col("v").asc()], ["w"])
    total = distinct_values(df, value, weight).agg(F.sum("w").alias("total"))  # one row
    target = lambda q: F.lit(q) * F.col("total")
    least = lambda k, met: F.min(F.when(met, F.col("v"))).alias(k)
    ends = [c for k, q in enumerate(shares) for c in (least(f"a{k}", F.col("cum_w") >= target(q)), least(f"b{k}", F.col("cum_w") > target(q)))]
    found = rows.join(F.broadcast(total)).agg(F.max("v").alias("top"), *ends)

    def between(k: int) -> Column:
        low = F.coalesce(F.col(f"a{k}"), F.col("top"))
        high = F.coalesce(F.col(f"b{k}"), low)
        mid = ((low.cast("double") + high.cast("double")) / 2).cast("float")
        return F.when((mid >= high) & (low < high), low).otherwise(mid)

    pairs = F.explode(F.array(*[F.struct(F.lit(q).alias("share"), between(k).alias("value")) for k, q in enumerate(shares)]))
    return found.select(pairs.alias("p")).select("p.*")
