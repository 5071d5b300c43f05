"""Actual against expected, deviances, ranking measures, drift and confusion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import unit_deviance, variance_function
from .ordered import running, small_side

#: Least share of a bin in the stability index.
FLOOR = 1e-4


def actual_expected(df: DataFrame, by: list[str], y: str, mu: str, weight: str) -> DataFrame:
    """Sums of each cell and their ratio; ae is null where nothing is expected."""
    w = F.col(weight).cast("double")
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("weight"), F.sum(w * F.col(y)).alias("actual"), F.sum(w * F.col(mu)).alias("expected"))
    return sums.withColumn("ae", F.try_divide("actual", "expected"))


def mean_deviance(df: DataFrame, loss: str, y: str, mu: str, weight: str, power: float = 1.5) -> DataFrame:
    w = F.col(weight).cast("double")
    return df.agg((F.sum(w * unit_deviance(loss, F.col(y), F.col(mu), power)) / F.sum(w)).alias("deviance"))


def multinomial_deviance(df: DataFrame, label: str, probabilities: dict[str, str], weight: str) -> DataFrame:
    w = F.col(weight).cast("double")
    own = F.coalesce(*[F.when(F.col(label) == k, F.col(c)) for k, c in probabilities.items()])
    return df.agg((F.sum(-2 * w * F.ln(F.greatest(own, F.lit(1e-15)))) / F.sum(w)).alias("deviance"))


def dispersion(df: DataFrame, loss: str, y: str, mu: str, weight: str, power: float = 1.5) -> DataFrame:
    """Pearson dispersion over the rows with weight and variance; 1 for a binomial outcome, or without such rows."""
    if loss == "binomial":
        return df.sparkSession.createDataFrame([(1.0,)], "dispersion double")
    w, v = F.col(weight).cast("double"), variance_function(loss, F.col(mu), power)
    gap, sound = F.col(y) - F.col(mu), (w > 0) & (v > 0)
    return df.agg(F.coalesce(F.sum(F.when(sound, w * gap * gap / v)) / F.sum(F.when(sound, w)), F.lit(1.0)).alias("dispersion"))


def null_rate(df: DataFrame, y: str, weight: str, exposure: str) -> DataFrame:
    """The constant rate of a log-link model, and its score."""
    w = F.col(weight).cast("double")
    rate = F.sum(w * F.col(y)) / F.sum(w * F.col(exposure))
    return df.agg(rate.alias("rate"), F.ln(rate).alias("score"))


def score_groups(df: DataFrame, score: Column, y: str, weight: str) -> DataFrame:
    """s, w, wy, n: weight, weighted target and rows of each distinct score; targets and weights below 0 count as 0."""
    w = F.greatest(F.col(weight).cast("double"), F.lit(0.0))
    return df.groupBy(score.alias("s")).agg(F.sum(w).alias("w"), F.sum(w * F.greatest(F.col(y).cast("double"), F.lit(0.0))).alias("wy"), F.count("*").alias("n"))


def lorenz_points(df: DataFrame, score: Column, y: str, weight: str) -> DataFrame:
    """s, n, dw, dy, cw, cy: shares of weight and target, and their sums in ascending order of the score; ties share a point."""
    groups = score_groups(df, score, y, weight)
    total = groups.agg(F.sum("w").alias("tw"), F.sum("wy").alias("ty"))  # one row
    share = lambda c, t: F.try_divide(F.col(c), F.col(t))
    return running(groups, [F.col("s").asc()], ["w", "wy"]).join(F.broadcast(total)).select("s", "n", share("w", "tw").alias("dw"), share("wy", "ty").alias("dy"), share("cum_w", "tw").alias("cw"), share("cum_wy", "ty").alias("cy"))


def gini(df: DataFrame, score: Column, y: str, weight: str) -> DataFrame:
    """1 less twice the area under the Lorenz curve of the target, ordered by the score; 0 where there is nothing to order."""
    area = F.sum(F.col("dw") * (2 * F.col("cy") - F.col("dy")))
    return lorenz_points(df, score, y, weight).agg(F.coalesce(1 - area, F.lit(0.0)).alias("gini"))


def ordered_gini(df: DataFrame, score: Column, y: str, weight: str) -> DataFrame:
    """The concentration Gini of ``score`` over that of the perfect order, by the target itself (1: perfect; 0 if that is 0)."""
    own, best = gini(df, score, y, weight), gini(df, F.col(y), y, weight)
    both = own.select(F.lit(0).alias("k"), "gini").union(best.select(F.lit(1), "gini"))
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("gini")))
    return both.agg(F.when(F.abs(pick(1)) <= 1e-12, 0.0).otherwise(F.try_divide(pick(0), pick(1))).alias("gini"))


def lift_curve(df: DataFrame, score: str, ties: list[str], n: int, y: str, mu: str, weight: str) -> DataFrame:
    """bucket (1 holds the highest scores), rows, mean_y, mean_pred and lift over the mean of all rows.

    Bucket b takes the places from b * rows // n to (b + 1) * rows // n of the descending order; ties go by ``ties``.
    """
    w = F.greatest(F.col(weight).cast("double"), F.lit(0.0))
    rows = df.select(score, *ties, w.alias("_w"), (w * F.col(y)).alias("_wy"), (w * F.col(mu)).alias("_wp"))
    whole = rows.agg(F.count("*").alias("_all"), (F.try_divide(F.sum("_wy"), F.sum("_w"))).alias("_mean"))  # one row
    placed = running(rows, [F.col(score).desc(), *[F.col(t).asc() for t in ties]], []).join(F.broadcast(whole))
    bucket = F.floor(((F.col("rank") + 1) * n - 1) / F.col("_all")).cast("int") + 1
    mean = lambda c: F.coalesce(F.try_divide(F.sum(c), F.sum("_w")), F.lit(0.0))
    sums = placed.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows"), mean("_wy").alias("mean_y"), mean("_wp").alias("mean_pred"), F.first("_mean").alias("_mean"))
    return sums.select("bucket", "rows", "mean_y", "mean_pred", F.when(F.abs("_mean") > 1e-12, F.col("mean_y") / F.col("_mean")).otherwise(0.0).alias("lift"))


def top_bucket_lift(df: DataFrame, score: str, ties: list[str], n: int, y: str, mu: str, weight: str) -> DataFrame:
    """lift of the bucket with the highest scores; 0 without rows."""
    return lift_curve(df, score, ties, n, y, mu, weight).where("bucket = 1").agg(F.coalesce(F.max("lift"), F.lit(0.0)).alias("lift"))


def lift_equal_mass(df: DataFrame, score: Column, n: int, y: str, weight: str) -> DataFrame:
    """band (1 to n by ascending score, of about equal weight), rows, weight, actual and predicted means.

    Tied scores share the band in which the middle of their weight lies; rows without weight take no part.
    """
    points = lorenz_points(df.where(F.col(weight) > 0), score, y, weight)
    totals = df.where(F.col(weight) > 0).agg(F.sum(F.col(weight).cast("double")).alias("tw"), F.sum(F.col(weight).cast("double") * F.greatest(F.col(y).cast("double"), F.lit(0.0))).alias("ty"))
    band = F.least(F.lit(n), 1 + F.floor((F.col("cw") - F.col("dw") / 2) * n + F.lit(1e-9))).cast("int")
    sums = points.groupBy(band.alias("band")).agg(F.sum("n").alias("rows"), F.sum("dw").alias("dw"), F.sum("dy").alias("dy"), F.sum(F.col("dw") * F.col("s")).alias("dp"))
    return sums.join(F.broadcast(totals)).select("band", "rows", (F.col("dw") * F.col("tw")).alias("weight"), (F.col("dy") * F.col("ty") / (F.col("dw") * F.col("tw"))).alias("actual"), (F.col("dp") / F.col("dw")).alias("predicted"))


def cell_quantiles(df: DataFrame, cell: str, value: str, weight: str, shares: list[float]) -> DataFrame:
    """cell, mean and q_1, q_2, ...: weighted lower quantiles of the distinct values in each cell."""
    w = F.col(weight).cast("double")
    values = df.groupBy(cell, F.col(value).alias("v")).agg(F.sum(w).alias("w"))
    total = values.groupBy(F.col(cell).alias("_cell")).agg(F.sum("w").alias("total"))
    placed = running(values, [F.col("v").asc()], ["w"], cell).join(small_side(total), F.col(cell).eqNullSafe(F.col("_cell")))
    quantiles = [F.min(F.when(F.col("cum_w") >= q * F.col("total"), F.col("v"))).alias(f"q_{k}") for k, q in enumerate(shares, 1)]
    return placed.groupBy(cell).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean"), *quantiles)


def stability_index(before: DataFrame, after: DataFrame, bin_: str, mass: str) -> DataFrame:
    """psi: sum of (q - p) ln(q / p) over bins, shares floored at FLOOR."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        sums = df.groupBy(bin_).agg(F.sum(F.col(mass).cast("double")).alias("m"))
        total = sums.agg(F.sum("m").alias("t"))
        return sums.join(F.broadcast(total)).select(bin_, (F.col("m") / F.col("t")).alias(name))

    both = shares(before, "p").join(shares(after, "q"), bin_, "full_outer")
    p, q = (F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(FLOOR)) for c in "pq")
    return both.agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))


def confusion(df: DataFrame, actual: str, predicted: str, weight: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count("*").alias("n"), F.sum(F.col(weight).cast("double")).alias("weight"))


def histogram_edges(df: DataFrame, value: str) -> tuple[float, float, bool]:
    """The 0.5th and 99.5th percentile of a column (interpolated), and whether bins between them are log-spaced.

    They are where both are positive and over a factor of 3 apart; of values that hardly vary, the range is widened.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    rows, least, most = counts.agg(F.sum("n"), F.min("v"), F.max("v")).first()
    if not rows:
        return 0.0, 1.0, False
    spots = [(q * (rows - 1), int(q * (rows - 1))) for q in (0.005, 0.995)]
    at = lambda k: F.min(F.when(F.col("cum_n") > k, F.col("v")))
    found = running(counts, [F.col("v").asc()], ["n"]).agg(*[at(min(k + d, rows - 1)) for _, k in spots for d in (0, 1)]).first()
    low, high = (found[2 * i] + (found[2 * i + 1] - found[2 * i]) * (x - k) for i, (x, k) in enumerate(spots))
    low, high = (low, high) if high > low else (least, most)
    high = high if high > low else low + (abs(low) * 0.1 or 1.0)
    return low, high, low > 0 and high / low > 3


def histogram(df: DataFrame, value: str, edges: tuple[float, float, bool], n: int, weight: str) -> DataFrame:
    """bin (0 to n - 1), n and weight between ``edges`` (:func:`histogram_edges`, of one table for all that are compared); values outside lie in the end bins."""
    low, high, log = edges
    scale = (lambda x: F.ln(F.greatest(x, F.lit(low)))) if log else (lambda x: x)
    start, end = (math.log(low), math.log(high)) if log else (low, high)
    at = F.floor((scale(F.col(value)) - start) / (end - start) * n)
    return df.groupBy(F.greatest(F.lit(0), F.least(F.lit(n - 1), at)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(weight).cast("double")).alias("weight"))
