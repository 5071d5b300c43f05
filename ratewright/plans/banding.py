"""Two-way banding: the pair tables of a model on a few bands of each axis, within a bound on the change of its scores.

What banding needs of the rows are sums of curvature by cell of each pair, in two halves of the rows, and in the end the
co-occurrence of bands; both are aggregates.  The bands themselves are chosen on sums of the size of the tables.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InputValueError
from ..functions import expr as X
from ..operators.cooccur import co_occurrence, drop, normal_equations, solve_ridge
from ..sources.shared import delete, new_path, written
from .boost import Model, Tables, _cell_value, purify, score_tables

#: Numbers of cuts an axis may have; None: all.
SCHEDULE = (1, 2, 3, 5, 7, 11, 15, 23, 31, 47, 63, 95, 127, 191, None)


@dataclass
class Report:
    budget: float
    #: Mean squared move by curvature, of each table alone and added up, and of all tables together.
    selected: float
    combined: float
    cells_before: int
    cells_after: int
    rounds: int


@dataclass
class Banded:
    constant: float
    tables: Tables
    #: For each pair, the band of each cell of its two axes.
    bands: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]
    report: Report


def _cost(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The variance that two groups lose as one, over what they hold in common; each is (weights, weighted sums)."""
    both = (a[0] > 0) & (b[0] > 0)
    w, x, v, y = a[0][both], a[1][both], b[0][both], b[1][both]
    return float((x * x / w + y * y / v - (x + y) ** 2 / (w + v)).sum())


def master_cuts(weights: np.ndarray, sums: np.ndarray) -> list[int]:
    """The cuts of an axis, most important first: a cut k parts cells up to k from those after it.

    ``weights`` and ``sums`` (weight times value) have a row for each cell and a column for each cell it meets in any table.  Cell 0
    (missing) is apart and not cut.  Neighbours merge, the cheapest first, of equal ones the first; a lazy heap holds the costs.
    """
    n = len(weights)
    group = {k: (weights[k].astype(float), sums[k].astype(float)) for k in range(1, n)}
    after = {k: k + 1 for k in range(1, n)}
    before = {k + 1: k for k in range(1, n)}
    age = dict.fromkeys(group, 0)
    end = {k: k for k in group}
    heap = [(_cost(group[k], group[k + 1]), k, 0, 0) for k in range(1, n - 1)]
    heapq.heapify(heap)
    removed = []
    while heap:
        _, k, mine, its = heapq.heappop(heap)
        m = after.get(k)
        if k not in group or m not in group or age[k] != mine or age[m] != its:
            continue  # one of the two has changed since
        removed.append(end[k])
        group[k] = (group[k][0] + group[m][0], group[k][1] + group[m][1])
        end[k] = end[m]
        del group[m]
        after[k] = after[m]
        before[after[m]] = k
        age[k] += 1
        for left in (before.get(k), k):
            right = after.get(left)
            if left in group and right in group:
                heapq.heappush(heap, (_cost(group[left], group[right]), left, age[left], age[right]))
    return removed[::-1]


def band_of(cells: int, cuts: list[int]) -> np.ndarray:
    """The band of each cell: 0 for missing, then 1, 2, ... parted by the cuts."""
    out = np.zeros(cells, int)
    if cells > 1:
        out[1:] = 1 + np.searchsorted(np.sort(np.array(cuts, int)), np.arange(1, cells), side="left")
    return out


def _block_means(values: np.ndarray, weights: np.ndarray, bands: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """In each cell, the weighted mean over its block."""
    p, q = bands
    shape = (p.max() + 1, q.max() + 1)
    at = p[:, None] * shape[1] + q[None, :]
    w = np.bincount(at.ravel(), weights.ravel(), shape[0] * shape[1])
    x = np.bincount(at.ravel(), (weights * values).ravel(), shape[0] * shape[1])
    plain = np.bincount(at.ravel(), values.ravel(), len(w)) / np.maximum(np.bincount(at.ravel(), minlength=len(w)), 1)
    return np.divide(x, w, out=plain, where=w > 0)[at]


def _size(bands: tuple[np.ndarray, np.ndarray]) -> int:
    return int((bands[0].max() + 1) * (bands[1].max() + 1))


def half_sums(df: DataFrame, bins: list[Column], sizes: list[int], h: Column, half: Column) -> list[Tables]:
    """Curvature by cell of each axis and each pair of axes, for the rows with ``half`` false and for those with true."""
    out = [{(a,): np.zeros(n) for a, n in enumerate(sizes)} | {(a, b): np.zeros((m, n)) for a, m in enumerate(sizes) for b, n in enumerate(sizes) if a < b} for _ in (0, 1)]
    for r in co_occurrence(df, bins, {"x": F.when(~half, h), "y": F.when(half, h)}).collect():  # a row for each pair of cells
        at = ((r["t"],), (r["c"],)) if r["t"] == r["u"] else ((r["t"], r["u"]), (r["c"], r["d"]))
        for table, name in zip(out, "xy", strict=True):
            table[at[0]][at[1]] += r[name]
    return out


def _choose(pairs: list[tuple[int, int]], tables: Tables, halves: list[Tables], weighed: list[Tables], cuts: dict[int, list[int]], total: float, budget: float):
    """Bands of each pair and the added-up move: buys the step that gains most for each cell added until within the budget."""
    step = {(k, x): 0 for k in pairs for x in (0, 1)}

    def bands(k, at) -> tuple[np.ndarray, np.ndarray]:
        return tuple(band_of(n, cuts[a][: SCHEDULE[at[x]]]) for x, (a, n) in enumerate(zip(k, tables[k].shape, strict=True)))

    def move(k, b) -> float:
        # Means of one half are held against the other.
        return sum(float((halves[1 - i][k] * (tables[k] - _block_means(tables[k], weighed[i][k], b)) ** 2).sum()) for i in (0, 1)) / total

    now = {k: bands(k, (0, 0)) for k in pairs}
    moves = {k: move(k, now[k]) for k in pairs}

    def offer(k):
        best = None
        for x in (0, 1):
            at = [step[k, 0], step[k, 1]]
            while at[x] + 1 < len(SCHEDULE):
                at[x] += 1
                b = bands(k, at)
                if _size(b) > _size(now[k]):
                    gain = (moves[k] - move(k, b)) / (_size(b) - _size(now[k]))
                    if best is None or gain > best[0]:
                        best = (gain, x, at[x], b)
                    break
        return best

    offers = {k: offer(k) for k in pairs}
    while sum(moves.values()) > budget and any(offers.values()):
        k = max((k for k in pairs if offers[k]), key=lambda k: offers[k][0])
        _, x, at, now[k] = offers[k]
        step[k, x] = at
        moves[k] = move(k, now[k])
        offers[k] = offer(k)
    return now, sum(moves.values())


def _combined(rows: DataFrame, bins: list[Column], tables: Tables, bands: dict, weighed: list[Tables]) -> float:
    """The curvature-weighted mean square of the moves of all tables together, each row by the means of the other half."""
    move: Column = F.lit(0.0)
    for k, b in bands.items():
        gap = [_cell_value(_block_means(tables[k], weighed[i][k], b) - tables[k], [bins[a] for a in k]) for i in (0, 1)]
        move = move + F.when(F.col("half"), gap[0]).otherwise(gap[1])
    found = rows.agg(F.sum(F.col("h") * move * move), F.sum("h")).first()
    return (found[0] or 0.0) / found[1] if found[1] else 0.0


def band_pairs(df: DataFrame, model: Model, constant: float, tables: Tables, y: str, weight: str | None = None, key: str = "id", tolerance: float = 0.75, sigma: float = np.inf, most_rise: float = np.inf, floor: float = 0.01, anchor: float = 1.0, distil: bool = True) -> Banded:
    """The pair tables of a model on bands, its scores moved by no more than a budget.

    ``tables`` are centred tables of ``model`` (main effects for both features of a pair); ``sigma`` is the noise of the scores
    (:func:`ratewright.operators.training.bag_variance` gives it), ``most_rise`` the largest rise of the mean deviance as a share of it.
    The curvature-weighted mean squared move, cross-fitted over two halves of the keys, stays within min((tolerance sigma)^2,
    what the rise allows); one of both must be finite.  ``floor`` is the share of the curvature that is spread over the product of the
    margins, so that no cell is without weight.  In the end all main effects and bands are refitted to the model's own scores, drawn to
    their means by ``anchor``.  Tables of three and more features stay.
    """
    s = model.settings
    sizes = [len(b) + 2 for b in model.borders]
    pairs = sorted(k for k in tables if len(k) == 2)
    if any((a,) not in tables for k in pairs for a in k):
        raise InputValueError("a pair has a feature without a main effect")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    scored = score_tables(df, model, constant, tables)
    _, h = X.grad_hess(s.loss, F.col(y).cast("double"), F.col("raw"), s.power)
    deviance = X.unit_deviance("binomial" if s.loss == "logistic" else s.loss, F.col(y).cast("double"), F.col("prediction"), s.power)
    binned, names = model.binned(scored.select(*model.features, F.col("raw").alias("_raw"), (w * h).alias("_h"), w.alias("_w"), (w * deviance).alias("_d"), (F.pmod(F.xxhash64(F.col(key)), F.lit(2)) == 1).alias("_half")))
    path = new_path(df.sparkSession, "banding")
    rows = written(binned.select(*[F.col(n).cast("short").alias(f"b{k}") for k, n in enumerate(names)], F.col("_raw").alias("raw"), F.col("_h").alias("h"), F.col("_w").alias("w"), F.col("_d").alias("d"), F.col("_half").alias("half")), path)
    try:
        return _banded(rows, model, constant, tables, pairs, sizes, tolerance * sigma, most_rise, floor, anchor, distil)
    finally:
        delete(df.sparkSession, path)


def _banded(rows: DataFrame, model: Model, constant: float, tables: Tables, pairs: list, sizes: list[int], noise: float, most_rise: float, floor: float, anchor: float, distil: bool) -> Banded:
    bins = [F.col(f"b{k}") for k in range(len(sizes))]
    sums = rows.agg(F.sum("h"), F.sum("d"), F.sum("w")).first()
    total = float(sums[0] or 0.0)
    allowed = [noise**2, most_rise * float(sums[1] or 0.0) / total if total and np.isfinite(most_rise) else np.inf]
    budget = min(allowed)
    if not (np.isfinite(budget) and budget >= 0):
        raise InputValueError("nothing bounds the move: give sigma or most_rise")
    halves = half_sums(rows, bins, sizes, F.col("h"), F.col("half"))
    margins = [halves[0][(a,)] + halves[1][(a,)] for a in range(len(sizes))]
    measure = [m / m.sum() if m.sum() > 0 else np.full(len(m), 1 / len(m)) for m in margins]
    spread = {k: floor * total * np.outer(measure[k[0]], measure[k[1]]) for k in pairs}
    weighed = [{k: part[k] + spread[k] / 2 for k in pairs} for part in halves]
    whole = {k: weighed[0][k] + weighed[1][k] for k in pairs}
    cuts = {}
    for a in sorted({x for k in pairs for x in k}):
        side = [(whole[k] if k[0] == a else whole[k].T, tables[k] if k[0] == a else tables[k].T) for k in pairs if a in k]
        cuts[a] = master_cuts(np.hstack([x for x, _ in side]), np.hstack([x * v for x, v in side]))

    # Moves of several tables add up or cancel; the bound is on their sum in each row, so the allotment shrinks until it holds.
    allot, rounds = budget, 0
    while True:
        rounds += 1
        bands, selected = _choose(pairs, tables, halves, weighed, cuts, total or 1.0, allot)
        combined = _combined(rows, bins, tables, bands, weighed)
        finest = all(len(np.unique(b)) == n for k in pairs for b, n in zip(bands[k], tables[k].shape, strict=True))
        if combined <= budget or finest:
            break
        allot = 0.0 if rounds > 12 else min(allot, selected) * min(0.8, budget / combined)
    blocks = {k: _block_means(tables[k], whole[k], bands[k]) for k in pairs}
    shift, banded = purify({k: blocks.get(k, t) for k, t in tables.items()}, measure)
    constant += shift
    if distil and pairs and total:
        constant, banded = _distilled(rows, bins, model.f0 + constant, banded, pairs, bands, measure, anchor * floor * total)
        constant -= model.f0
        shift, banded = purify(banded, measure)
        constant += shift
    before, after = sum(tables[k].size for k in pairs), sum(_size(bands[k]) for k in pairs)
    return Banded(constant, banded, bands, Report(budget, selected, combined, before, after, rounds))


def _distilled(rows: DataFrame, bins: list[Column], level: float, tables: Tables, pairs: list, bands: dict, measure: list[np.ndarray], strength: float) -> tuple[float, Tables]:
    """Main effects and bands refitted to the scores of the rows, by least squares over the co-occurrence of their cells."""
    mains = sorted(k for k in tables if len(k) == 1)
    cells, sizes, ridge = [bins[k[0]] for k in mains], [len(tables[k]) for k in mains], [strength * measure[k[0]] for k in mains]
    for k in pairs:
        p, q = bands[k]
        n = q.max() + 1
        cells.append(_cell_value(p[:, None] * n + q[None, :], [bins[a] for a in k]))
        sizes.append(_size(bands[k]))
        held = np.outer(np.bincount(p, measure[k[0]], p.max() + 1), np.bincount(q, measure[k[1]], n))
        ridge.append(strength * held.ravel())
    now: Column = F.lit(level)
    for k, t in tables.items():
        now = now + _cell_value(t, [bins[a] for a in k])
    system, gradient, path = normal_equations(rows, [c.cast("int") for c in cells], sizes, F.col("h"), F.col("h") * (F.col("raw") - now))
    try:
        step = solve_ridge(system, gradient, np.maximum(np.concatenate(ridge), 1e-12))
    finally:
        drop(rows, path)
    parts = np.split(step, np.cumsum(sizes)[:-1])
    out = dict(tables)
    for k, x in zip(mains, parts, strict=False):
        out[k] = tables[k] + x
    for k, x in zip(pairs, parts[len(mains) :], strict=True):
        p, q = bands[k]
        out[k] = tables[k] + x.reshape(p.max() + 1, -1)[p][:, q]
    return level, out
