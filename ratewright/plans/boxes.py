"""Effects of many features as boxes, without a dense table.

A tree's leaf is a box: on each of its features an interval of bins, with or without the missing ones.  A centred effect
is a sum of value * product over its features of (inside - share inside), where the share is that of the reference measure: its mean over any
feature is zero whatever the measures, so centring is algebra on boxes and what it pushes down is again boxes.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import expr as X
from .boost import Model, Tree

#: A side of a box: bins from lo to hi (1 and more), and whether missing values (bin 0) are inside.
Side = tuple[int, int, bool]
#: For each set of features, the value of each box by its sides.
Boxes = dict[tuple[int, ...], dict[tuple[Side, ...], float]]

#: Rows times boxes that are multiplied out at a time.
BLOCK = 1 << 21


def inside(side: Side, n_bins: int) -> np.ndarray:
    """Which of the bins 0, 1, ... a side holds."""
    lo, hi, missing = side
    bins = np.arange(n_bins)
    return np.where(bins == 0, missing, (bins >= lo) & (bins <= hi))


def _sides(tree: Tree, axis: int, last: int) -> dict[int, Side]:
    """The side of each combination of the tree's splits on an axis, by their bits in the leaf number; empty ones left out."""
    splits = [(level, s) for level, s in enumerate(tree.splits) if s.axis == axis]
    found = {}
    for choice in range(1 << len(splits)):
        lo, hi, missing, bits = 1, last, True, 0
        for k, (level, s) in enumerate(splits):
            low = bool(choice >> k & 1)
            bits |= low << level
            lo, hi = (lo, min(hi, s.bin_le)) if low else (max(lo, s.bin_le + 1), hi)
            missing = missing and s.missing_low == low
        if lo <= hi or missing:
            found[bits] = (lo, hi, missing) if lo <= hi else (1, 0, missing)
    return found


def _add(boxes: Boxes, axes: tuple[int, ...], sides: tuple[Side, ...], value: float) -> None:
    some = boxes.setdefault(axes, {})
    some[sides] = some.get(sides, 0.0) + value


def tree_boxes(trees: Sequence[Tree], sizes: Sequence[int]) -> Boxes:
    """The leaves of the trees as plain boxes (value inside, 0 outside); equal boxes are one."""
    out: Boxes = {}
    for t in trees:
        axes = tuple(sorted({s.axis for s in t.splits}))
        whole: list[tuple[int, tuple[Side, ...]]] = [(0, ())]
        for a in axes:
            whole = [(bits | b, (*sides, side)) for bits, sides in whole for b, side in _sides(t, a, sizes[a] - 1).items()]
        for leaf, sides in whole:
            _add(out, axes, sides, float(t.leaves[leaf]))
    return out


def centred(plain: Boxes, measure: Sequence[np.ndarray]) -> tuple[float, Boxes]:
    """Constant and centred effects of all orders whose sum is that of the plain boxes.

    A product of indicators is expanded into shares and centred factors: each subset of the features gets a box.  A side that leaves out
    nothing has no centred factor, and one and its complement differ only by sign, so of the two the one with the lower end stays.
    """
    shares = [m / m.sum() for m in measure]
    constant, out = 0.0, {}
    for axes, boxes in plain.items():
        for sides, value in boxes.items():
            if not value:
                continue
            share = [float(shares[a] @ inside(s, len(shares[a]))) for a, s in zip(axes, sides, strict=True)]
            for r in range(len(axes) + 1):
                for some in combinations(range(len(axes)), r):
                    v = value * float(np.prod([share[k] for k in range(len(axes)) if k not in some]))
                    if not r:
                        constant += v
                        continue
                    kept = [_folded(sides[k], len(shares[axes[k]])) for k in some]
                    if v and all(x is not None for x in kept):
                        sign = float(np.prod([x[1] for x in kept]))
                        _add(out, tuple(axes[k] for k in some), tuple(x[0] for x in kept), sign * v)
    return constant, {k: {s: v for s, v in b.items() if v} for k, b in out.items()}


def _folded(side: Side, n_bins: int) -> tuple[Side, int] | None:
    """The side or its complement, whichever starts at bin 1, and the sign of its centred factor; None where the side holds all."""
    lo, hi, missing = side
    if lo > hi:
        lo, hi = 1, 0
    if (lo, hi, missing) in ((1, n_bins - 1, True), (1, 0, False)):
        return None
    if lo > 1 and hi == n_bins - 1:
        return (1, lo - 1, not missing), -1
    if (lo, hi) == (1, n_bins - 1):  # all that is present: the complement of missing
        return (1, 0, True), -1
    return (lo, hi, missing), 1


class Effect:
    """The centred boxes of one set of features, indexed by bin: for each feature, the factor of each box in each bin."""

    def __init__(self, axes: tuple[int, ...], boxes: dict[tuple[Side, ...], float], measure: Sequence[np.ndarray]):
        self.axes, self.values = axes, np.array(list(boxes.values()), float)
        self.share, self.inside = [], []
        for k, a in enumerate(axes):
            m = measure[a] / measure[a].sum()
            held = np.array([inside(s[k], len(m)) for s in boxes]).reshape(len(boxes), len(m))
            self.inside.append(held)
            self.share.append(held @ m)
        self.factors = [(h - s[:, None]).T.copy() for h, s in zip(self.inside, self.share, strict=True)]

    def at(self, bins: Sequence[np.ndarray]) -> np.ndarray:
        """The effect of rows from the bins of its features."""
        out = np.zeros(len(bins[0]))
        step = max(1, BLOCK // max(1, len(self.values)))
        for x in range(0, len(out), step):
            part = self.values
            for f, b in zip(self.factors, bins, strict=True):
                part = part * f[b[x : x + step]]
            out[x : x + step] = part.sum(axis=-1)
        return out

    def variance(self, measure: Sequence[np.ndarray]) -> float:
        """Its variance under the product of the measures: box by box, the product of the covariances of their sides."""
        total, n = 0.0, len(self.values)
        step = max(1, BLOCK // max(1, n))
        for x in range(0, n, step):
            part = self.values[x : x + step, None] * self.values
            for a, h, s in zip(self.axes, self.inside, self.share, strict=True):
                m = measure[a] / measure[a].sum()
                part = part * ((h[x : x + step] * m) @ h.T - s[x : x + step, None] * s)
            total += float(part.sum())
        return total

    def dense(self) -> np.ndarray:
        """The effect as a table; for small ones only."""
        shape = [len(f) for f in self.factors]
        return self.at([g.ravel() for g in np.indices(shape)]).reshape(shape)


def effects(boxes: Boxes, measure: Sequence[np.ndarray]) -> list[Effect]:
    return [Effect(k, b, measure) for k, b in sorted(boxes.items()) if b]


def effect_value(effect: Effect, bins: Sequence[Column]) -> Column:
    """The effect of each row; bins go over in Arrow batches and meet the index there."""

    @pandas_udf("double")
    def value(*columns: pd.Series) -> pd.Series:
        return pd.Series(effect.at([c.to_numpy() for c in columns]))

    return value(*[b.cast("int") for b in bins])


def score_boxes(df: DataFrame, model: Model, constant: float, parts: list[Effect]) -> DataFrame:
    """``df`` with raw and prediction from the constant and the effects, in place of columns of these names."""
    binned, names = model.binned(df)
    raw = F.lit(model.f0 + constant)
    for e in parts:
        raw = raw + effect_value(e, [F.col(names[a]) for a in e.axes])
    scored = binned.withColumn("raw", raw).drop(*names)
    return scored.withColumn("prediction", X.inverse_link(X.LINKS[model.settings.loss], F.col("raw")))


def factored(model: Model, measure: Sequence[np.ndarray]) -> tuple[float, list[Effect]]:
    """A model as constant and centred effects of boxes; ``measure`` as of :func:`ratewright.plans.boost.axis_weights`."""
    constant, boxes = centred(tree_boxes(model.trees, [len(b) + 2 for b in model.borders]), measure)
    return constant, effects(boxes, measure)
