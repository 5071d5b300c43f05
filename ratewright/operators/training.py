"""Gradient histograms, leaf sums, split choice and bag statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import newton_gain, newton_step


def gradient_histogram(df: DataFrame, leaf: Column, bins: dict[int, Column], g: Column, h: Column, weight: Column) -> DataFrame:
    """leaf, axis, bin, g, h, n, w: sums of each leaf, axis and bin in one shuffle.

    Map-side partial sums leave at most leaves * axes * 256 rows for each task.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), b.cast("int").alias("bin")) for a, b in bins.items()]))
    rows = df.select(leaf.cast("int").alias("leaf"), g.cast("double").alias("g"), h.cast("double").alias("h"), weight.cast("double").alias("w"), cells.alias("c"))
    return rows.groupBy("leaf", "c.axis", "c.bin").agg(F.sum(F.col("g") * F.col("w")).alias("g"), F.sum(F.col("h") * F.col("w")).alias("h"), F.count("*").alias("n"), F.sum("w").alias("w"))


def split_gains(hist: DataFrame, l2: float) -> DataFrame:
    """axis, bin_le, gain of each split of all leaves at once, missing values on the high side."""
    upto = Window.partitionBy("leaf", "axis").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("leaf", "axis")
    shown = F.when(F.col("bin") > 0, F.col("g")).otherwise(0.0), F.when(F.col("bin") > 0, F.col("h")).otherwise(0.0)
    sides = hist.select("leaf", "axis", "bin", F.sum(shown[0]).over(upto).alias("gl"), F.sum(shown[1]).over(upto).alias("hl"), F.sum("g").over(whole).alias("gt"), F.sum("h").over(whole).alias("ht"))
    score = lambda g, h: g * g / (h + l2)
    gain = score(F.col("gl"), F.col("hl")) + score(F.col("gt") - F.col("gl"), F.col("ht") - F.col("hl")) - score(F.col("gt"), F.col("ht"))
    return sides.where("bin > 0").groupBy("axis", F.col("bin").alias("bin_le")).agg(F.sum(gain).alias("gain"))


def best_split(gains: DataFrame) -> DataFrame:
    """The split of the highest gain (to nine decimals); ties go to the lowest axis, then bin."""
    best = gains.agg(F.min(F.struct((-F.round("gain", 9)).alias("loss"), "axis", "bin_le", "gain")).alias("b"))
    return best.select("b.axis", "b.bin_le", "b.gain")


def leaf_values(df: DataFrame, leaf: Column, g: Column, h: Column, weight: Column, l2: float, rate: float = 1.0) -> DataFrame:
    """leaf, value: -rate * sum(g) / (sum(h) + l2)."""
    w = weight.cast("double")
    return df.groupBy(leaf.cast("int").alias("leaf")).agg((-rate * F.sum(g * w) / (F.sum(h * w) + l2)).alias("value"), F.count("*").alias("n"))


def jury_mean(df: DataFrame, key: list[str], score: str, in_bag: str) -> DataFrame:
    """Mean score and number of the bags that do not hold the row."""
    out = F.when(~F.col(in_bag), F.col(score))
    return df.groupBy(*key).agg(F.avg(out).alias("jury"), F.count(out).alias("bags"))


def bag_variance(df: DataFrame, key: list[str], score: str, curvature: str) -> DataFrame:
    """sigma2: curvature-weighted mean over rows of the sample variance over bags."""
    rows = df.groupBy(*key).agg(F.var_samp(score).alias("v"), F.max(curvature).alias("h"))
    return rows.agg((F.sum(F.col("v") * F.col("h")) / F.sum("h")).alias("sigma2"))


def all_split_gains(hist: DataFrame, l2: float, l1: float = 0.0, most: float | None = None) -> DataFrame:
    """axis, bin_le, missing_low, gain: half the Newton gain of each split of all leaves at once.

    Bin 0 holds missing values.  They go to the high or low side; ``bin_le`` 0 parts them from all others.  The last
    bin is no split.  A leaf without rows in a bin still counts at that split, with its sums so far.
    """
    tops = hist.groupBy("axis").agg(F.max("bin").alias("top"))
    cells = hist.select("leaf", "axis").distinct().join(F.broadcast(tops), "axis").select("leaf", "axis", F.explode(F.sequence(F.lit(0), F.greatest("top", F.lit(1)) - 1)).alias("bin"))
    sums = hist.groupBy(F.col("leaf").alias("_l"), F.col("axis").alias("_a"), F.col("bin").alias("_b")).agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    whole = hist.groupBy(F.col("leaf").alias("_tl"), F.col("axis").alias("_ta")).agg(
        F.sum("g").alias("gt"), F.sum("h").alias("ht"), F.sum(F.when(F.col("bin") == 0, F.col("g")).otherwise(0.0)).alias("gm"), F.sum(F.when(F.col("bin") == 0, F.col("h")).otherwise(0.0)).alias("hm")
    )
    # A model-sized table: leaves x axes x 256 rows at most.
    placed = cells.join(sums, (F.col("leaf") == F.col("_l")) & (F.col("axis") == F.col("_a")) & (F.col("bin") == F.col("_b")), "left").join(F.broadcast(whole), (F.col("leaf") == F.col("_tl")) & (F.col("axis") == F.col("_ta")))
    upto = Window.partitionBy("leaf", "axis").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    shown = lambda c: F.sum(F.when(F.col("bin") > 0, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0)).over(upto)
    sides = placed.select("axis", "bin", "gt", "ht", "gm", "hm", shown("g").alias("gl"), shown("h").alias("hl")).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("missing_low")).where("bin > 0 OR missing_low")
    g, h = (F.col(f"{c}l") + F.when(F.col("missing_low"), F.col(f"{c}m")).otherwise(0.0) for c in "gh")
    term = lambda a, b: newton_gain(a, b, l2, l1, most)
    gain = term(g, h) + term(F.col("gt") - g, F.col("ht") - h) - term(F.col("gt"), F.col("ht"))
    return sides.groupBy("axis", F.col("bin").alias("bin_le"), "missing_low").agg((0.5 * F.sum(gain)).alias("gain"))


def best_of_all_splits(gains: DataFrame) -> DataFrame:
    """The split of the highest gain (to nine decimals); ties go to the lowest axis, then bin, then missing high."""
    best = gains.agg(F.min(F.struct((-F.round("gain", 9)).alias("loss"), "axis", "bin_le", "missing_low", "gain")).alias("b"))
    return best.select("b.axis", "b.bin_le", "b.missing_low", "b.gain")


def whole_number_histogram(df: DataFrame, leaf: Column, bins: dict[int, Column], g: Column, h: Column, bits: int = 20) -> DataFrame:
    """leaf, axis, bin, g, h, n: sums of gradients in units of 2 ** -bits, as longs, so that no order of addition shows."""
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), b.cast("int").alias("bin")) for a, b in bins.items()]))
    units = lambda c: F.round(c.cast("double") * (1 << bits)).cast("long")
    rows = df.select(leaf.cast("int").alias("leaf"), units(g).alias("g"), units(h).alias("h"), cells.alias("c"))
    return rows.groupBy("leaf", "c.axis", "c.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n"))


def sibling_histogram(parent: DataFrame, child: DataFrame, depth: int) -> DataFrame:
    """The histogram of both children of each leaf, from the parents' and that of the low children alone.

    A child's leaf is its parent's with bit ``depth`` set; the other child keeps the number and takes the difference.
    Cells without rows are left out.
    """
    low = child.select((F.col("leaf") - (1 << depth)).alias("_leaf"), F.col("axis").alias("_axis"), F.col("bin").alias("_bin"), *[F.col(c).alias(f"_{c}") for c in ("g", "h", "n", "w")])
    met = (F.col("leaf") == F.col("_leaf")) & (F.col("axis") == F.col("_axis")) & (F.col("bin") == F.col("_bin"))
    rest = parent.join(low, met, "left").select("leaf", "axis", "bin", *[(F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in ("g", "h", "n", "w")])
    return rest.where("n > 0").unionByName(child.select("leaf", "axis", "bin", "g", "h", "n", "w"))


def newton_leaves(df: DataFrame, leaf: Column, g: Column, h: Column, weight: Column, l2: float, l1: float, rate: float, most: float | None) -> DataFrame:
    """leaf, value, g, h, n: the leaf's step with threshold and bound, and its sums."""
    w = weight.cast("double")
    sums = df.groupBy(leaf.cast("int").alias("leaf")).agg(F.sum(g * w).alias("g"), F.sum(h * w).alias("h"), F.count("*").alias("n"))
    return sums.select("leaf", (rate * newton_step(F.col("g"), F.col("h"), l2, l1, most)).alias("value"), "g", "h", "n")


def path_smoothed(leaves: DataFrame, depth: int, strength: float, l2: float, l1: float, rate: float, most: float | None) -> DataFrame:
    """leaf, value: each node of the path to a leaf moved towards its parent, with credibility n / (n + strength).

    ``leaves`` has leaf, value, g, h, n (:func:`newton_leaves`); above the root stands 0.  The windows run over at most
    2 ** depth leaves.
    """
    above: Column = F.lit(0.0)
    for level in range(depth + 1):
        node = Window.partitionBy(F.col("leaf") % (1 << level))
        n = F.sum("n").over(node)
        own = F.col("value") if level == depth else rate * newton_step(F.sum("g").over(node), F.sum("h").over(node), l2, l1, most)
        above = (own * n + above * strength) / (n + strength)
    return leaves.select("leaf", above.alias("value"))


def sign_coefficients(leaves: DataFrame, depth: int = 3) -> DataFrame:
    """mask, coefficient: the mean over all leaves of value * (-1) ** (bits that mask and leaf share).

    Mask 0 is the constant, one bit a main effect, more an interaction; leaves that are absent count as 0.
    """
    masks = leaves.select("leaf", "value", F.explode(F.sequence(F.lit(0), F.lit((1 << depth) - 1))).alias("mask"))
    odd = F.bit_count(F.col("mask").bitwiseAND(F.col("leaf"))) % 2 == 1
    return masks.groupBy("mask").agg((F.sum(F.when(odd, -F.col("value")).otherwise(F.col("value"))) / (1 << depth)).alias("coefficient"))
