"""Credibility measured from the data: the strength of shrinkage of a categorical feature, and serving of its encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InputValueError
from ..sources.shared import new_path, written
from .encode import RARE, base_rate, level_of, level_sums, pool_rare, shrunken
from .ordered import small_side

# Fixed values of the estimator: squared z from which a level counts as credible, the mean of (z^2 - 1) above that
# under pure noise, the greatest strength, and the least variance taken for more than rounding.
CREDIBLE_Z2 = 9.0
NOISE_MEAN = 0.0266
MOST_STRENGTH = 1e6
LEAST_VARIANCE = 1e-12


def auto_strength(df: DataFrame, level: str, y: str, weight: str, exposure: str) -> DataFrame:
    """strength: that of the shrinkage (one row), from the noise within levels and the spread of the credible ones.

    Three levels or more: only levels over three standard errors from the base rate tell the spread.  Two or fewer:
    the ratio of the variances within and between.  Rows without weight or exposure take no part; null without rows.
    Level sums are joined back to the rows, since sums of squares alone would lose the digits of a small variance.
    """
    w = F.col(weight).cast("double") * F.col(exposure)
    rows = df.where(w > 0).select(level_of(F.col(level)).alias("_level"), w.alias("_w"), (F.col(y) / F.col(exposure)).cast("double").alias("_rate"))
    sums = rows.groupBy(F.col("_level").alias("level")).agg(F.sum("_w").alias("w"), (F.sum(F.col("_w") * F.col("_rate")) / F.sum("_w")).alias("mean"))
    base = sums.agg((F.sum(F.col("w") * F.col("mean")) / F.sum("w")).alias("base"))  # one row
    gap = F.col("_rate") - F.col("mean")
    noise = rows.join(small_side(sums), F.col("_level") == F.col("level")).agg(F.sum(F.col("_w") * gap * gap).alias("ss"))  # one row
    spread = F.col("mean") - F.col("base")
    between = sums.join(F.broadcast(base)).agg(F.sum("w").alias("total"), F.count("*").alias("n"), F.sum(F.col("w") * spread * spread).alias("bs"))
    within = F.col("ss") / F.greatest(F.col("total") - F.col("n"), F.lit(LEAST_VARIANCE))
    facts = between.join(F.broadcast(noise)).select("total", "n", "bs", "ss", within.alias("s2"))
    z2 = F.try_divide(F.col("w") * spread * spread, F.col("s2"))
    known = sums.join(F.broadcast(base)).join(F.broadcast(facts))
    credible = known.agg(F.sum(F.when(z2 > CREDIBLE_Z2, z2 - 1)).alias("zs"), F.sum(F.when(z2 > CREDIBLE_Z2, F.col("w"))).alias("ws"))
    tau2 = F.try_divide(F.col("s2") * (F.col("zs") - NOISE_MEAN * F.col("n")), F.col("ws"))
    many = F.when(F.col("s2") <= LEAST_VARIANCE, 0.0).when(tau2 > LEAST_VARIANCE, F.least(F.try_divide(F.col("s2"), tau2), F.lit(MOST_STRENGTH))).otherwise(MOST_STRENGTH)
    vb, vw = F.col("bs") / F.col("total"), F.col("ss") / F.col("total")
    few = F.when(vb > LEAST_VARIANCE, F.least(F.try_divide(vw, vb), F.lit(MOST_STRENGTH))).when(vw <= LEAST_VARIANCE, 0.0).otherwise(MOST_STRENGTH)
    return facts.join(F.broadcast(credible)).select(F.when(F.col("n") == 0, None).when(F.col("n") <= 2, few).otherwise(many).alias("strength"))


def auto_encoding(df: DataFrame, level: str, y: str, weight: str, exposure: str, least: float = 0.0) -> DataFrame:
    """level, member, encoding of each level, shrunken with :func:`auto_strength`."""
    pooled = pool_rare(level_sums(df, level, y, weight, exposure), least)
    # Levels are pooled before their credibility is measured.
    rows = df
    if least > 0:
        names = small_side(pooled.select(F.col("member").alias("_member"), F.col("level").alias("_pooled")))
        rows = df.join(names, level_of(F.col(level)) == F.col("_member")).select("*", F.col("_pooled").alias("_lv"))
        level = "_lv"
    facts = auto_strength(rows, level, y, weight, exposure).join(F.broadcast(base_rate(df, y, weight, exposure)))
    return pooled.join(F.broadcast(facts)).select("level", "member", shrunken(F.col("wy"), F.col("we"), F.col("base"), F.col("strength")).alias("encoding"))


def level_count(df: DataFrame, level: str, y: str, weight: str, exposure: str, least: float) -> DataFrame:
    """n: distinct levels once those under ``least`` exposure are pooled."""
    return pool_rare(level_sums(df, level, y, weight, exposure), least).agg(F.countDistinct("level").alias("n"))


def serve_encoding(df: DataFrame, column: str, encoded: DataFrame, base: float, unseen: str = "default") -> DataFrame:
    """``df`` with column encoding, from ``encoded`` (level, member, encoding).

    A level that was not seen takes the pooled rare level's encoding (``unseen='rare'``; the base value if nothing was
    pooled), the base value (``'default'``), or is an error that names some of them (``'error'``).
    """
    if unseen not in ("rare", "default", "error"):
        raise InputValueError(f"unseen must be rare, default or error, not {unseen}")
    known = encoded.select(F.col("member").alias("_member"), F.col("encoding").alias("_encoding"))
    own = level_of(F.col(column))
    if unseen == "error":
        lost = df.select(own.alias("_own")).distinct().join(known, F.col("_own") == F.col("_member"), "left_anti").limit(5).collect()
        if lost:
            raise InputValueError(f"column {column} has unseen values: {', '.join(r[0] for r in lost)}")
    fallback = None
    if unseen == "rare":
        fallback = encoded.where(F.col("level") == RARE).agg(F.first("encoding")).first()[0]
    joined = df.join(small_side(known), own == F.col("_member"), "left")
    return joined.select(*df.columns, F.coalesce("_encoding", F.lit(base if fallback is None else fallback)).alias("encoding"))


def kfold_rows(df: DataFrame, column: str, fold: str, encoded: DataFrame, base: float) -> DataFrame:
    """``df`` with column encoding: that of the row's level and fold (level, fold, encoding), else ``base``."""
    known = encoded.select(F.col("level").alias("_level"), F.col(fold).alias("_fold"), F.col("encoding").alias("_encoding"))
    met = (level_of(F.col(column)) == F.col("_level")) & (F.col(fold) == F.col("_fold"))
    return df.join(small_side(known), met, "left").select(*df.columns, F.coalesce("_encoding", F.lit(base)).alias("encoding"))


def logit_shift(df: DataFrame, y: str, start: Column, weight: str, rounds: int = 100) -> DataFrame:
    """shift: the c with sum of w * (y - sigmoid(c + start)) = 0 (one row; null where the mean target is not inside 0 to 1).

    Rows are first summed by their distinct ``start``.  Newton steps that leave the bracket halve it instead.
    """
    spark = df.sparkSession
    w = F.col(weight).cast("double")
    sums = written(df.groupBy(start.cast("double").alias("s")).agg(F.sum(w).alias("w"), F.sum(w * F.col(y)).alias("wy")), new_path(spark, "shift"))
    total, target, mean_start, low, high = sums.agg(F.sum("w"), F.sum("wy"), F.sum(F.col("w") * F.col("s")), F.min("s"), F.max("s")).first()
    c = None
    if total and 0 < target < total:
        odds = math.log(target / (total - target))
        # sigmoid(c + s) lies between its values at the least and the greatest s, which brackets the root
        left, right, c = odds - high, odds - low, odds - mean_start / total
        for _ in range(rounds):
            mu = 1 / (1 + F.exp(-(F.lit(c) + F.col("s"))))
            g, h = sums.agg(F.sum(F.col("wy") - F.col("w") * mu), F.sum(F.col("w") * mu * (1 - mu))).first()
            left, right = (c, right) if g > 0 else (left, c)
            step = c + g / h if h > 0 else math.nan
            step = step if left <= step <= right else (left + right) / 2
            done, c = abs(step - c) <= 1e-12 * max(1.0, abs(c)), step
            if done:
                break
    return spark.createDataFrame([(c,)], "shift double")

