"""Bags of models: out-of-bag juries, prefixes of ranked tables, fold votes, averages of banks, sampling and recalibration."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import LINKS, grad_hess, inverse_link, unit_deviance
from .ordered import running


def _running_sums(columns: list[Column]) -> list[Column]:
    return [reduce(lambda a, b: a + b, columns[: k + 1]) for k in range(len(columns))]


def jury_sums(bags: DataFrame, key: list[str], in_bag: str, parts: list[str]) -> DataFrame:
    """The columns ``key``, jury (number of bags that do not hold the row) and the sums of ``parts`` over them.

    ``bags`` has one row for each row and bag; rows that every bag holds are left out.
    """
    return bags.where(~F.col(in_bag)).groupBy(*key).agg(F.count("*").alias("jury"), *[F.sum(c).alias(c) for c in parts])


def prefix_deviances(juries: DataFrame, parts: list[str], loss: str, y: str, weight: str, power: float = 1.5) -> DataFrame:
    """prefix (0, 1, ...), deviance: mean deviance of the jury's mean score by the first parts, all in one pass.

    ``juries`` is :func:`jury_sums`; part 0 is the start, each later one a group of tables.  Scores of tables add up,
    so no prefix is scored on its own.
    """
    kind, w = "binomial" if loss == "logistic" else loss, F.col(weight).cast("double")
    scores = [s / F.col("jury") for s in _running_sums([F.col(c) for c in parts])]
    one = lambda raw: F.sum(w * unit_deviance(kind, F.col(y), inverse_link(LINKS[loss], raw), power)) / F.sum(w)
    costs = juries.agg(*[one(raw).alias(f"d{k}") for k, raw in enumerate(scores)])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("prefix"), F.col(f"d{k}").alias("deviance")) for k in range(len(parts))]))
    return costs.select(pairs.alias("p")).select("p.*")


def drop_gains(df: DataFrame, fold: str, start: Column, parts: dict[str, Column], loss: str, y: str, weight: str, power: float = 1.5) -> DataFrame:
    """fold, table_id, gain: how much the fold's mean deviance rises when a table is left out; one shuffle of folds."""
    kind, w = "binomial" if loss == "logistic" else loss, F.col(weight).cast("double")
    rows = df.select(fold, F.col(y).cast("double").alias("_y"), w.alias("_w"), start.alias("_start"), *[p.alias(f"_p{k}") for k, p in enumerate(parts.values())])
    names = [f"_p{k}" for k in range(len(parts))]
    raw = reduce(lambda a, b: a + b, map(F.col, names), F.col("_start"))
    cost = lambda r: F.sum(F.col("_w") * unit_deviance(kind, F.col("_y"), inverse_link(LINKS[loss], r), power)) / F.sum("_w")
    costs = rows.groupBy(fold).agg(cost(raw).alias("_all"), *[cost(raw - F.col(n)).alias(n) for n in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("table_id"), (F.col(n) - F.col("_all")).alias("gain")) for t, n in zip(parts, names, strict=True)]))
    return costs.select(fold, pairs.alias("p")).select(fold, "p.*")


def fold_votes(gains: DataFrame, folds: int, least_gain: float = 0.0, stability: float = 0.5, z: float = 2.0) -> DataFrame:
    """table_id, n, mean_gain, se, positive_rate, legacy_keep, evidence_keep of each table.

    ``gains`` has table_id, gain and kept (whether the fold itself kept the table).  A table stays by the first
    rule if its mean gain is above ``least_gain`` and enough folds kept it or gained by it; by the second unless its mean
    gain lies ``z`` standard errors below 0 (with fewer than two folds, as the first rule says).
    """
    sums = gains.groupBy("table_id").agg(
        F.count("gain").alias("n"),
        F.avg("gain").alias("mean_gain"),
        (F.stddev_samp("gain") / F.sqrt(F.count("gain"))).alias("se"),
        F.avg(F.when(F.col("gain") > 0, 1.0).otherwise(0.0)).alias("positive_rate"),
        (F.sum(F.when(F.col("kept"), 1.0).otherwise(0.0)) / folds).alias("kept_rate"),
    )
    first = (F.col("mean_gain") > least_gain) & ((F.col("kept_rate") >= stability) | (F.col("positive_rate") >= stability))
    second = F.when(F.col("n") < 2, first).otherwise(~(F.col("mean_gain") < -z * F.col("se")))
    return sums.select("table_id", "n", "mean_gain", "se", "positive_rate", first.alias("legacy_keep"), second.alias("evidence_keep"))


def average_banks(banks: DataFrame) -> DataFrame:
    """table_id, upper, value: the mean of the bags' one-way tables on the union of their borders.

    ``banks`` has bag, table_id, upper (the right end of a cell; null for the last one) and value.  A bag without a
    table counts as 0 there.  Model-sized: a row for each bag, table and border.
    """
    every = banks.agg(F.countDistinct("bag").alias("bags"))  # one row
    cells = banks.select("table_id", F.col("upper").alias("at")).distinct()
    owners = banks.select(F.col("table_id").alias("_table"), F.col("bag").alias("_bag")).distinct()
    grid = cells.join(owners, F.col("table_id") == F.col("_table")).select("table_id", "at", "_bag")
    known = banks.select(F.col("table_id").alias("_t"), F.col("bag").alias("_b"), "upper", "value")
    met = (F.col("table_id") == F.col("_t")) & (F.col("_bag") == F.col("_b")) & F.col("at").eqNullSafe(F.col("upper"))
    # From the highest cell down, a border the bag lacks takes the value of the bag's next one above.
    down = Window.partitionBy("table_id", "_bag").orderBy(F.col("at").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(known, met, "left").select("table_id", "at", F.last("value", ignorenulls=True).over(down).alias("value"))
    sums = filled.groupBy("table_id", "at").agg(F.sum("value").alias("value"))
    return sums.join(F.broadcast(every)).select("table_id", F.col("at").alias("upper"), (F.col("value") / F.col("bags")).alias("value"))


def sampling_threshold(df: DataFrame, gradient: Column, rate: float) -> DataFrame:
    """threshold, sure: a row is drawn with the chance min(1, size of gradient / threshold), the ``sure`` largest for certain.

    The chances sum to ``rate`` times the rows, or all rows with a gradient are sure, where they are fewer.  Rows of
    equal gradient are counted first, so that the order is one over distinct values; without any gradient there is no row.
    """
    sizes = df.select(F.abs(gradient).cast("double").alias("g")).where("g > 0").groupBy("g").agg(F.count("*").alias("n"))
    placed = running(sizes.withColumn("s", F.col("g") * F.col("n")), [F.col("g").desc()], ["n", "s"])
    totals = sizes.agg(F.sum(F.col("g") * F.col("n")).alias("ts")).join(F.broadcast(df.agg((F.count("*") * rate).alias("wanted"))))
    before_n, before_s = F.col("cum_n") - F.col("n"), F.col("cum_s") - F.col("s")
    tried = placed.join(F.broadcast(totals)).select("g", before_n.alias("sure"), F.when(F.col("wanted") > before_n, (F.col("ts") - before_s) / (F.col("wanted") - before_n)).alias("threshold"))
    # The largest gradient below its own threshold: all above it are drawn for certain.
    fits = F.col("threshold") >= F.col("g")
    best = tried.join(F.broadcast(sizes.agg(F.min("g").alias("least"), F.sum("n").alias("some")))).agg(
        F.max_by(F.when(fits, F.struct("threshold", "sure")), F.when(fits, F.col("g"))).alias("b"), F.max(F.struct(F.col("least").alias("threshold"), F.col("some").alias("sure"))).alias("all")
    )
    return best.select(F.coalesce("b", "all").alias("b")).where("b IS NOT NULL").select("b.threshold", "b.sure")


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) of a key and a seed alone: the same on every try of a task, and for every engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def drawn_rows(df: DataFrame, gradient: Column, rate: float, key: Column, seed: str, least: int = 1) -> DataFrame:
    """The rows of ``df`` drawn with a chance in proportion to the size of their gradient, with ``inverse``, 1 / chance.

    The chances sum to ``rate`` times the rows, or to ``least``, if that is more; sums of inverse * x over the drawn rows have the mean of
    sums of x over all with a gradient.  Rows are drawn by their key, so equal keys are drawn alike.  Rows with the largest gradients are
    sure.  Without any gradient none is drawn.
    """
    n = df.count()
    found = sampling_threshold(df, gradient, min(1.0, max(rate, least / n))).first() if n else None
    if found is None:
        return df.where(F.lit(False)).withColumn("inverse", F.lit(1.0))
    chance = F.least(F.lit(1.0), F.abs(gradient) / F.lit(float(found["threshold"])))
    return df.withColumn("inverse", chance).where((F.col("inverse") > 0) & (draw(key, seed) < F.col("inverse"))).withColumn("inverse", 1 / F.col("inverse"))


def class_histogram(df: DataFrame, leaf: Column, bins: dict[int, Column], label: str, probabilities: dict[str, Column], weight: str) -> DataFrame:
    """class, leaf, axis, bin, g, h, n: softmax gradients (p - hit) and curvatures (p (1 - p)) of each class, in one shuffle.

    Probabilities are columns of their own before rows are repeated for each axis, and classes become rows only once
    they are summed: expressions inside an explode are evaluated again for each use.
    """
    w, every = F.col("w"), range(len(probabilities))
    rows = df.select(leaf.cast("int").alias("leaf"), F.col(weight).cast("double").alias("w"), F.col(label).alias("label"), *[b.cast("int").alias(f"b{a}") for a, b in bins.items()], *[p.alias(f"p{k}") for k, p in enumerate(probabilities.values())])
    hits = [F.when(F.col("label") == c, 1.0).otherwise(0.0) for c in probabilities]
    steps = [x for k in every for x in (((F.col(f"p{k}") - hits[k]) * w).alias(f"g{k}"), ((F.col(f"p{k}") * (1 - F.col(f"p{k}"))) * w).alias(f"h{k}"))]
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"b{a}").alias("bin")) for a in bins]))
    flat = rows.select("leaf", *[f"b{a}" for a in bins], *steps).select("leaf", *[f"{c}{k}" for k in every for c in "gh"], cells.alias("c"))
    sums = flat.groupBy("leaf", "c.axis", "c.bin").agg(*[F.sum(f"{c}{k}").alias(f"{c}{k}") for k in every for c in "gh"], F.count("*").alias("n"))
    classes = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"g{k}").alias("g"), F.col(f"h{k}").alias("h")) for k, c in enumerate(probabilities)]))
    return sums.select("leaf", "axis", "bin", "n", classes.alias("k")).select("k.class", "leaf", "axis", "bin", "k.g", "k.h", "n")


def slope_recalibration(df: DataFrame, y: str, raw: Column, weight: str, loss: str = "poisson", ridge: float = 1.0, steps: int = 6, power: float = 1.5) -> tuple[float, float, float]:
    """(b0, b1, gain): b0 + b1 * raw fits best, each moved towards (0, 1) by ``ridge``; (0, 1, 0) unless it pays.

    Newton's method: each step is one pass that sums five numbers.  It pays if the summed deviance falls by more than
    the penalty that the move costs.
    """
    rows = df.select(F.col(y).cast("double").alias("y"), F.col(weight).cast("double").alias("w"), raw.alias("r"))
    at = np.array([0.0, 1.0])
    for _ in range(steps):
        g, h = grad_hess(loss, F.col("y"), F.lit(float(at[0])) + F.lit(float(at[1])) * F.col("r"), power)
        sums = rows.agg(*[F.sum(F.col("w") * x) for x in (g, g * F.col("r"), h, h * F.col("r"), h * F.col("r") * F.col("r"))]).first()
        if sums[0] is None:
            return 0.0, 1.0, 0.0
        slope = np.array([sums[0], sums[1]]) + ridge * (at - [0.0, 1.0])
        curve = np.array([[sums[2], sums[3]], [sums[3], sums[4]]]) + ridge * np.eye(2)
        at = at - np.linalg.solve(curve, slope)
    kind = "binomial" if loss == "logistic" else loss
    cost = lambda r: F.sum(F.col("w") * unit_deviance(kind, F.col("y"), inverse_link(LINKS[loss], r), power))
    before, after = rows.agg(cost(F.col("r")), cost(F.lit(float(at[0])) + F.lit(float(at[1])) * F.col("r"))).first()
    gain, penalty = before - after, ridge * float(at[0] ** 2 + (at[1] - 1) ** 2)
    return (float(at[0]), float(at[1]), float(gain)) if gain > penalty else (0.0, 1.0, 0.0)


def cell_corrections(df: DataFrame, cells: dict[str, Column], g: Column, h: Column, weight: str, ridge: float) -> DataFrame:
    """table_id, cell, delta: one ridge step on the working residual, for the cells of all tables together.

    Rows are summed to the curvature that each pair of cells shares, in one shuffle; the sums are solved on the
    driver (a row and column for each cell).
    """
    w = F.col(weight).cast("double")
    names = list(cells)
    rows = df.select((w * g).alias("g"), (w * h).alias("h"), *[c.cast("int").alias(f"c{k}") for k, c in enumerate(cells.values())])
    pairs = [F.struct(F.lit(a).alias("a"), F.col(f"c{a}").alias("ca"), F.lit(b).alias("b"), F.col(f"c{b}").alias("cb")) for a in range(len(names)) for b in range(a, len(names))]
    sums = rows.select("g", "h", F.explode(F.array(*pairs)).alias("p")).groupBy("p.a", "p.ca", "p.b", "p.cb").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
    spots = {k: i for i, k in enumerate(sorted({(r["a"], r["ca"]) for r in sums if r["a"] == r["b"]}))}
    slope, curve = np.zeros(len(spots)), ridge * np.eye(len(spots))
    for r in sums:
        i, j = spots[r["a"], r["ca"]], spots[r["b"], r["cb"]]
        curve[i, j] += r["h"]
        if i == j:
            slope[i] += r["g"]
        else:
            curve[j, i] += r["h"]
    delta = np.linalg.solve(curve, -slope) if spots else slope
    out = [(names[a], int(c), float(delta[i])) for (a, c), i in spots.items()]
    return df.sparkSession.createDataFrame(out, "table_id string, cell int, delta double")
