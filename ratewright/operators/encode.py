"""Target statistics of categorical levels: pooling, shrinkage, out-of-fold, ordered and count encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running

#: Levels that stand for missing values and for pooled rare ones.
MISSING = "__missing__"
RARE = "<rare>"


def level_of(column: Column) -> Column:
    """The level of a value: MISSING for a null; values that look like a reserved level are told apart by a prefix."""
    text = column.cast("string")
    taken = F.startswith(text, F.lit(MISSING)) | F.startswith(text, F.lit(RARE))
    return F.when(text.isNull(), F.lit(MISSING)).when(taken, F.concat(F.lit(f"{MISSING}:"), text)).otherwise(text)


def base_rate(df: DataFrame, y: str, weight: str, exposure: str) -> DataFrame:
    """base: weighted target over weighted exposure."""
    w = F.col(weight).cast("double")
    return df.agg((F.sum(w * F.col(y)) / F.sum(w * F.col(exposure))).alias("base"))


def level_sums(df: DataFrame, level: str, y: str, weight: str, exposure: str, *by: str) -> DataFrame:
    """level, wy, we, n: sums of each level (null levels pooled), besides the columns ``by``."""
    w = F.col(weight).cast("double")
    return df.groupBy(level_of(F.col(level)).alias("level"), *by).agg(F.sum(w * F.col(y)).alias("wy"), F.sum(w * F.col(exposure)).alias("we"), F.count("*").alias("n"))


def pool_rare(sums: DataFrame, least: float) -> DataFrame:
    """level, member, wy, we: levels under ``least`` exposure share the level RARE, with its sums."""
    named = sums.select(F.col("level").alias("member"), F.when(F.col("we") < least, RARE).otherwise(F.col("level")).alias("level"), "wy", "we")
    own = Window.partitionBy("level")
    return named.select("level", "member", F.sum("wy").over(own).alias("wy"), F.sum("we").over(own).alias("we"))


def shrunken(wy: Column, we: Column, base: Column, strength: float) -> Column:
    """(sum of targets + strength * base) / (sum of exposure + strength)."""
    return (wy + strength * base) / (we + strength)


def fixed_encoding(df: DataFrame, level: str, y: str, weight: str, exposure: str, strength: float, least: float = 0.0) -> DataFrame:
    """level, member, encoding of each level, with fixed credibility."""
    pooled = pool_rare(level_sums(df, level, y, weight, exposure), least)
    base = F.broadcast(base_rate(df, y, weight, exposure))  # one row
    return pooled.join(base).select("level", "member", shrunken(F.col("wy"), F.col("we"), F.col("base"), strength).alias("encoding"))


def kfold_encoding(df: DataFrame, level: str, y: str, weight: str, exposure: str, fold: str, strength: float) -> DataFrame:
    """level, fold, encoding: each fold's encoding from the rows of the other folds."""
    sums = level_sums(df, level, y, weight, exposure, fold)
    of_level = Window.partitionBy("level")
    other = lambda c: F.sum(c).over(of_level) - F.col(c)
    # The base rate of a fold is that of the other folds; sums has a row for each level and fold.
    totals = sums.groupBy(fold).agg(F.sum("wy").alias("fy"), F.sum("we").alias("fe"))
    every = totals.agg(F.sum("fy").alias("ty"), F.sum("fe").alias("te"))
    bases = totals.join(F.broadcast(every)).select(F.col(fold).alias("_fold"), ((F.col("ty") - F.col("fy")) / (F.col("te") - F.col("fe"))).alias("base"))
    rows = sums.select("level", fold, other("wy").alias("oy"), other("we").alias("oe"))
    return rows.join(bases, F.col(fold) == F.col("_fold")).select("level", fold, shrunken(F.col("oy"), F.col("oe"), F.col("base"), strength).alias("encoding"))


def leave_one_out(df: DataFrame, level: str, y: str, weight: str, exposure: str, strength: float) -> DataFrame:
    """``df`` with column encoding: the level's encoding without the row itself."""
    w = F.col(weight).cast("double")
    wy, we = w * F.col(y), w * F.col(exposure)
    sums = level_sums(df, level, y, weight, exposure).select(F.col("level").alias("_level"), F.col("wy").alias("_wy"), F.col("we").alias("_we"))
    total = sums.agg(F.sum("_wy").alias("_ty"), F.sum("_we").alias("_te"))
    joined = df.join(sums, level_of(F.col(level)) == F.col("_level")).join(F.broadcast(total))
    base = (F.col("_ty") - wy) / (F.col("_te") - we)
    return joined.withColumn("encoding", shrunken(F.col("_wy") - wy, F.col("_we") - we, base, strength)).drop("_level", "_wy", "_we", "_ty", "_te")


def ordered_encoding(df: DataFrame, level: str, y: str, weight: str, exposure: str, strength: float, base: float, order: list[Column]) -> DataFrame:
    """``df`` with column encoding: the level's encoding from the rows before it."""
    w = F.col(weight).cast("double")
    rows = df.withColumns({"_level": level_of(F.col(level)), "_wy": w * F.col(y), "_we": w * F.col(exposure)})
    placed = running(rows, order, ["_wy", "_we"], "_level")
    past = lambda c: F.col(f"cum_{c}") - F.col(c)
    return placed.select(*df.columns, shrunken(past("_wy"), past("_we"), F.lit(base), strength).alias("encoding"))


def count_channel(df: DataFrame, level: str, weight: str) -> DataFrame:
    """level, channel: log1p of the level's share of the weight times the number of rows."""
    sums = df.groupBy(level_of(F.col(level)).alias("level")).agg(F.sum(F.col(weight).cast("double")).alias("w"), F.count("*").alias("n"))
    total = sums.agg(F.sum("w").alias("tw"), F.sum("n").alias("tn"))
    return sums.join(F.broadcast(total)).select("level", F.log1p(F.col("w") / F.col("tw") * F.col("tn")).alias("channel"))


def class_frequencies(df: DataFrame, level: str, label: str, weight: str, classes: list[str]) -> DataFrame:
    """level and one column p_<class> for each class: the weighted share of the class in the level."""
    w = F.col(weight).cast("double")
    shares = [(F.sum(F.when(F.col(label) == c, w).otherwise(0.0)) / F.sum(w)).alias(f"p_{c}") for c in classes]
    return df.groupBy(level_of(F.col(level)).alias("level")).agg(*shares)


def rank_bins(encoded: DataFrame, n_bins: int) -> DataFrame:
    """level, bin: levels in order of their encoding, dealt evenly to at most ``n_bins`` bins (from 1)."""
    order = Window.orderBy(F.round("encoding", 9))
    ranked = encoded.select("level", (F.dense_rank().over(order) - 1).alias("rank"))
    size = ranked.agg((F.max("rank") + 1).alias("n"))
    bins = F.least(F.col("n"), F.lit(n_bins))
    return ranked.join(F.broadcast(size)).select("level", (1 + F.floor(F.col("rank") * bins / F.col("n"))).cast("int").alias("bin"))


def unseen_values(df: DataFrame, features: list[str], known: DataFrame, mass: str) -> DataFrame:
    """feature, value, n, mass of values that ``known`` (feature, value) lacks."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), level_of(F.col(f)).alias("value")) for f in features]))
    counted = df.select(F.col(mass).cast("double").alias("m"), pairs.alias("p")).groupBy("p.feature", "p.value").agg(F.count("*").alias("n"), F.sum("m").alias("mass"))
    return counted.join(known, ["feature", "value"], "left_anti")
