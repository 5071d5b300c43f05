"""Measures of a model report: percentiles, sampled Lorenz curves, bands of cells, drift by band, class matrices, holdouts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running, small_side
from .review import FLOOR, lorenz_points


def percentiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """share, value: percentiles with linear interpolation between neighbours; missing values take no part.

    Distinct values are counted first, so no task holds all of them.
    """
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("v")).agg(F.count("*").alias("n"))
    placed = running(counts, [F.col("v").asc()], ["n"])
    size = counts.agg(F.sum("n").alias("rows"))  # one row
    spot = lambda q: F.lit(q) * (F.col("rows") - 1)
    at = lambda name, k: F.min(F.when(F.col("cum_n") > k, F.col("v"))).alias(name)
    ends = [c for i, q in enumerate(shares) for c in (at(f"a{i}", F.floor(spot(q))), at(f"b{i}", F.ceil(spot(q))))]
    found = placed.join(F.broadcast(size)).groupBy("rows").agg(*ends)
    value_of = lambda i, q: F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (spot(q) - F.floor(spot(q)))
    pairs = F.explode(F.array(*[F.struct(F.lit(q).alias("share"), value_of(i, q).alias("value")) for i, q in enumerate(shares)]))
    return found.select(pairs.alias("p")).select("p.*")


def sampled_lorenz(df: DataFrame, score: Column, y: str, weight: str, points: int = 101) -> DataFrame:
    """x, y at ``points`` even places of the Lorenz curve, interpolated along its segments."""
    last = points - 1
    before, after = F.col("cw") - F.col("dw"), F.col("cw")
    segments = lorenz_points(df, score, y, weight).where("dw > 0")
    # a place on the joint of two segments lies on both, which agree there
    first, upto = F.ceil(before * last - 1e-7).cast("int"), F.floor(after * last + 1e-7).cast("int")
    places = segments.where(first <= upto).select("*", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(upto, F.lit(last)))).alias("k"))
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("k") / last - before) / F.col("dw")))
    return places.groupBy("k").agg(F.min(F.col("cy") - F.col("dy") + F.col("dy") * along).alias("y")).select((F.col("k") / last).alias("x"), "y")


def cell_groups(mass: list[float], most: int = 10, categorical: bool = False) -> list[int]:
    """The band of each cell: cell 0 (missing) alone, the others in at most ``most`` - 1 bands.

    Few enough cells stand alone.  Levels: the heaviest alone, the rest together.  Numeric cells: runs of about equal
    mass; a band ends at the cell whose running mass reaches its share, and a cell ends one band at most.
    """
    own, room = np.asarray(mass[1:], dtype=float), most - 1
    n = len(own)
    if n <= room:
        return [0, *range(1, n + 1)]
    if categorical:
        place = np.empty(n, dtype=int)
        place[np.lexsort((np.arange(n), -own))] = np.arange(n)
        return [0, *(1 + np.minimum(place, room - 1)).tolist()]
    total = own.sum()
    if total <= 0:
        return [0] + [1] * n
    reached = np.searchsorted(total * np.arange(1, room) / room, np.cumsum(own), side="right")
    at = np.arange(1, n + 1)
    ended = np.minimum(at, at + np.minimum.accumulate(reached - at))  # bands that end up to and with a cell
    return [0, *(1 + np.r_[0, ended[:-1]]).tolist()]


def masses(df: DataFrame, cell: str, mass: Column, n_cells: int) -> list[float]:
    """The mass of cells 0 to n_cells - 1 (an axis of a table: at most some hundred)."""
    out = [0.0] * n_cells
    for c, m in df.where(F.col(cell).between(0, n_cells - 1)).groupBy(cell).agg(F.sum(mass.cast("double"))).collect():
        out[c] = m or 0.0
    return out


def band_of(cell: Column, groups: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(g) for g in groups]), cell.cast("int") + 1)


def factor_bands(df: DataFrame, band: Column, y: str, mu: str, weight: str, mass: Column, variance: Column) -> DataFrame:
    """band, rows, mass, actual, expected, ae, sd, z; ae is null where nothing is expected, sd and z without variance."""
    w = F.col(weight).cast("double")
    sums = df.groupBy(band.alias("band")).agg(F.count("*").alias("rows"), F.sum(mass.cast("double")).alias("mass"), F.sum(w * F.col(y)).alias("actual"), F.sum(w * F.col(mu)).alias("expected"), F.sum(w * variance).alias("_v"))
    sound, noise = F.col("expected") > 0, F.col("_v") > 0
    root = F.sqrt("_v")
    return sums.select(
        "band", "rows", "mass", "actual", "expected",
        F.when(sound, F.col("actual") / F.col("expected")).alias("ae"),
        F.when(sound & noise, root / F.col("expected")).alias("sd"),
        F.when(noise, (F.col("actual") - F.col("expected")) / root).alias("z"),
    )


def stability_bands(before: DataFrame, after: DataFrame, band: str, mass: str) -> DataFrame:
    """band, p, q, term: shares of the band before and after, and its part of the stability index (shares floored)."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        sums = df.groupBy(band).agg(F.sum(F.col(mass).cast("double")).alias("m"))
        return sums.join(F.broadcast(sums.agg(F.sum("m").alias("t")))).select(F.col(band).alias("band"), (F.col("m") / F.col("t")).alias(name))

    both = shares(before, "p").join(shares(after, "q"), "band", "full_outer").select("band", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    p, q = F.greatest("p", F.lit(FLOOR)), F.greatest("q", F.lit(FLOOR))
    return both.select("band", "p", "q", ((q - p) * F.ln(q / p)).alias("term"))


def expected_classes(df: DataFrame, actual: str, probabilities: dict[str, str], weight: str) -> DataFrame:
    """actual, predicted, expected: the probability mass that rows of a class give to each class."""
    w = F.col(weight).cast("double")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("predicted"), (w * F.col(c)).alias("m")) for k, c in probabilities.items()]))
    return df.select(F.col(actual).alias("actual"), pairs.alias("p")).groupBy("actual", "p.predicted").agg(F.sum("p.m").alias("expected"))


def accuracy(df: DataFrame, actual: str, probabilities: dict[str, str], weight: str) -> DataFrame:
    """accuracy: weighted share of rows whose likeliest class (the first of equals) is the actual one; null without weight."""
    w = F.col(weight).cast("double")
    top = F.greatest(*[F.col(c) for c in probabilities.values()]) if len(probabilities) > 1 else F.col(next(iter(probabilities.values())))
    said = F.coalesce(*[F.when(F.col(c) == top, F.lit(k)) for k, c in probabilities.items()])
    return df.agg(F.try_divide(F.sum(F.when(said == F.col(actual), w).otherwise(0.0)), F.sum(w)).alias("accuracy"))


def holdout(df: DataFrame, keys: list[str], share: float, seed: int, stratum: Column | None = None) -> DataFrame:
    """keys, held: the first ``share`` of each stratum (rounded down), in the order of a digest of seed and keys."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    rows = df.select(*keys, mark.alias("_mark"), (stratum if stratum is not None else F.lit(0)).alias("_stratum"))
    sizes = rows.groupBy(F.col("_stratum").alias("_s")).agg(F.count("*").alias("_n"))
    placed = running(rows, [F.col("_mark").asc(), *[F.col(k).asc() for k in keys]], [], "_stratum")
    return placed.join(small_side(sizes), F.col("_stratum").eqNullSafe(F.col("_s"))).select(*keys, (F.col("rank") < F.floor(F.col("_n") * share)).alias("held"))


def group_holdout(df: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """group, held: whole groups, the first ``share`` of them (rounded down) in the order of a digest of seed and group."""
    return holdout(df.select(group).distinct(), [group], share, seed)
