"""Fully-corrective refit: all leaves of an ensemble anew, by ridge-regularised Newton steps with the trees held fixed."""

from __future__ import annotations

import json
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators.cooccur import drop, normal_equations, solve_ridge
from ..sources.book import validate
from ..sources.shared import delete, new_path, written
from .boost import Model, Settings, Tree

#: Step lengths tried, from the full Newton step down.
STEPS = [0.5**k for k in range(12)]


def _leaf_value(leaf: Column, values: np.ndarray) -> Column:
    """The value of a leaf number; the table is one constant of the plan, however many leaves there are."""
    table = F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")
    return F.element_at(table, leaf + 1)


def _score(leaves: Column, values: np.ndarray) -> Column:
    return F.aggregate(leaves, F.lit(0.0), lambda total, leaf: total + _leaf_value(leaf, values))


def refit_values(rows: DataFrame, sizes: list[int], values: np.ndarray, s: Settings, l2: float, passes: int = 3, tolerance: float = 1e-10) -> tuple[np.ndarray, list[float]]:
    """New leaf values and the penalised mean loss before and after each pass.

    ``rows`` has leaves (array<int>, the number of the row's leaf in each tree among all leaves), base (the linear predictor
    without trees), y and w.  Each pass solves (A'HA + l2) step = -(A'g + l2 values) from one shuffle of pairs of leaves, then takes
    the longest of the halved steps that lowers sum(w * loss) + l2 / 2 * |values|^2; a pass that finds none is the last.
    """
    deviance = "binomial" if s.loss == "logistic" else s.loss
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    raw = lambda v: F.col("base") + _score(F.col("leaves"), v)

    def losses(tries: list[np.ndarray]) -> list[float]:
        cost = [F.sum(F.col("w") * X.unit_deviance(deviance, F.col("y"), X.inverse_link(X.LINKS[s.loss], raw(v)), s.power) / 2) for v in tries]
        found = rows.agg(*cost, F.sum("w")).first()
        return [(float(c) + l2 / 2 * float(v @ v)) / float(found[-1]) for c, v in zip(found[:-1], tries, strict=True)]

    history = losses([values])
    for _ in range(passes):
        g, h = X.grad_hess(s.loss, F.col("y"), F.col("raw"), s.power)
        scored = rows.withColumn("raw", raw(values))
        cells = [F.get(F.col("leaves"), t) - int(starts[t]) for t in range(len(sizes))]
        pairs, gradient, path = normal_equations(scored, cells, sizes, F.col("w") * h, F.col("w") * g)
        try:
            step = solve_ridge(pairs, -(gradient + l2 * values), np.full(len(values), float(l2)), tolerance)
        finally:
            drop(rows, path)
        # Few tries in one pass over the rows; the full step nearly always does.
        for some in (STEPS[:2], STEPS[2:6], STEPS[6:]):
            found = losses([values + k * step for k in some])
            better = [(k, x) for k, x in zip(some, found, strict=True) if x < history[-1]]
            if better:
                break
        if not better:
            break
        values = values + better[0][0] * step
        history.append(better[0][1])
    return values, history


def leaf_numbers(trees: list[Tree], bins: list[Column]) -> tuple[Column, list[int]]:
    """The numbers of a row's leaves among all leaves of all trees, and the number of leaves of each tree."""
    sizes = [len(t.leaves) for t in trees]
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    at = [X.leaf_index([(bins[x.axis], x.bin_le, x.missing_low) for x in t.splits]) + int(starts[k]) for k, t in enumerate(trees)]
    return F.array(*[a.cast("int") for a in at]), sizes


def with_values(trees: list[Tree], values: np.ndarray) -> list[Tree]:
    cuts = np.cumsum([len(t.leaves) for t in trees])[:-1]
    return [Tree(t.splits, [float(v) for v in part]) for t, part in zip(trees, np.split(values, cuts), strict=True)]


def refit_leaves(df: DataFrame, model: Model, y: str, weight: str | None = None, exposure: str | None = None, l2: float = 1.0, passes: int = 3) -> tuple[Model, list[float]]:
    """``model`` with all leaves refitted together on the rows of ``df``, and the penalised mean loss by pass, which never rises.

    Splits, grids, encodings and constant stay.  Null targets or weights are refused, as in fitting; a model without trees
    is returned as it is; without rows nothing moves.
    """
    s = model.settings
    validate(df, y, weight, exposure, positive=s.loss == "gamma")
    if not model.trees or df.isEmpty():
        return model, []
    w, e = F.col(weight).cast("double") if weight else F.lit(1.0), F.col(exposure).cast("double") if exposure else F.lit(1.0)
    offset = F.ln(e) if X.LINKS[s.loss] == "log" else F.lit(0.0)
    keep = df.select(*model.features, F.col(y).cast("double").alias("_y"), w.alias("_w"), (F.lit(model.f0) + offset).alias("_base"))
    binned, names = model.binned(keep)
    leaves, sizes = leaf_numbers(model.trees, [F.col(n) for n in names])
    path = new_path(df.sparkSession, "leaves")
    rows = written(binned.select(leaves.alias("leaves"), F.col("_base").alias("base"), F.col("_y").alias("y"), F.col("_w").alias("w")), path)
    try:
        start = np.concatenate([np.array(t.leaves, float) for t in model.trees])
        values, history = refit_values(rows, sizes, start, s, l2, passes)
    finally:
        delete(df.sparkSession, path)
    return replace(model, trees=with_values(model.trees, values)), history
