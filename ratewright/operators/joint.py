"""Effects under the joint measure of two features in place of the product of their margins.

A pair table whose slice means are taken over the product of the margins counts combinations that never occur.  Under
the joint measure it is parted anew: what the two features explain alone, each averaged over the other's cells as they
occur with it, goes to the main effects, a level to the constant.  The sum of all effects stays as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame

from ..errors import InputValueError
from .cooccur import co_occurrence

Tables = dict[tuple[int, ...], np.ndarray]


def pair_masses(df: DataFrame, bins: Sequence[Column], sizes: Sequence[int], mass: Column) -> Tables:
    """The mass of each cell of each axis and of each pair of axes: one pass over the rows, a result of the size of the tables."""
    out: Tables = {(a,): np.zeros(n) for a, n in enumerate(sizes)}
    out |= {(a, b): np.zeros((m, n)) for a, m in enumerate(sizes) for b, n in enumerate(sizes) if a < b}
    for r in co_occurrence(df, bins, {"mass": mass}).collect():
        if r["t"] == r["u"]:
            out[(r["t"],)][r["c"]] += r["mass"]
        else:
            out[r["t"], r["u"]][r["c"], r["d"]] += r["mass"]
    return out


def _share(mass: np.ndarray) -> np.ndarray:
    total = mass.sum()
    return mass / total if total > 0 else np.full(mass.shape, 1.0 / mass.size)


def joint_weights(mass: np.ndarray, first: np.ndarray, second: np.ndarray, floor: float) -> np.ndarray:
    """Shares of the cells of a pair, each with ``floor`` times the product of its margins on top; sums to one."""
    product = np.outer(first, second)
    s = mass / mass.sum() + floor * product if mass.sum() > 0 else product
    return s / s.sum()


def project(values: np.ndarray, s: np.ndarray, first: np.ndarray, second: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """c, a and b that minimise sum s (values - c - a - b)^2 + ridge (sum first a^2 + sum second b^2), a and b centred by their margins.

    Cells without mass keep 0.  The system is that of one pair: at most as many unknowns as its two axes have cells.
    """
    i, j = np.flatnonzero(first > 0), np.flatnonzero(second > 0)
    w, v = s[np.ix_(i, j)], values[np.ix_(i, j)]
    n = 1 + len(i) + len(j)
    m = np.zeros((n, n))
    row, column = w.sum(axis=1), w.sum(axis=0)
    m[0, 0] = w.sum()
    m[0, 1 : 1 + len(i)] = m[1 : 1 + len(i), 0] = row
    m[0, 1 + len(i) :] = m[1 + len(i) :, 0] = column
    m[1 : 1 + len(i), 1 : 1 + len(i)] = np.diag(row + ridge * first[i])
    m[1 + len(i) :, 1 + len(i) :] = np.diag(column + ridge * second[j])
    m[1 : 1 + len(i), 1 + len(i) :] = w
    m[1 + len(i) :, 1 : 1 + len(i)] = w.T
    x = np.linalg.lstsq(m, np.concatenate([[(w * v).sum()], (w * v).sum(axis=1), (w * v).sum(axis=0)]), rcond=None)[0]
    a, b = np.zeros(len(first)), np.zeros(len(second))
    a[i], b[j] = x[1 : 1 + len(i)], x[1 + len(i) :]
    # With a ridge both are centred already; without one, a level may lie anywhere.
    down, right = float(first @ a), float(second @ b)
    a[i] -= down
    b[j] -= right
    return float(x[0]) + down + right, a, b


def rejoint(constant: float, tables: Tables, masses: Tables, ridge: float = 1e-3, floor: float = 1e-6) -> tuple[float, Tables]:
    """Constant and tables under the joint measure of ``masses`` (of :func:`pair_masses`); their sum in each cell is unchanged.

    Every feature of a pair needs a main effect.  Tables of three and more features stay as they are.
    """
    if not (np.isfinite([ridge, floor]).all() and ridge >= 0 and floor >= 0):
        raise InputValueError("ridge and floor must be finite and not negative")
    out = {k: t.astype(float).copy() for k, t in tables.items()}
    for pair in [k for k in tables if len(k) == 2]:
        if any((a,) not in out for a in pair):
            raise InputValueError(f"pair {pair} has a feature without a main effect")
        if any(len(masses[(a,)]) != n for a, n in zip(pair, tables[pair].shape, strict=True)):
            raise InputValueError(f"the cells of pair {pair} differ from those of its features")
        first, second = (_share(masses[(a,)]) for a in pair)
        c, a, b = project(tables[pair], joint_weights(masses[pair], first, second, floor), first, second, ridge)
        out[pair] = tables[pair] - c - a[:, None] - b[None, :]
        out[(pair[0],)] += a
        out[(pair[1],)] += b
        constant += c
    for k in [k for k in out if len(k) == 1]:
        level = float(_share(masses[k]) @ out[k])
        out[k] -= level
        constant += level
    return constant, out


def conditional_means(tables: Tables, masses: Tables) -> dict[tuple[int, ...], list[np.ndarray]]:
    """For each pair, the mean of the effect in each cell of either axis, over the other's cells as they occur with it; for each
    main effect its mean.  Cells without mass have mean 0."""
    out = {}
    for k, t in tables.items():
        if len(k) == 1:
            out[k] = [np.array([float(_share(masses[k]) @ t)])]
        elif len(k) == 2:
            m = masses[k]
            total = [m.sum(axis=1 - x) for x in (0, 1)]
            out[k] = [np.divide((m * t).sum(axis=1 - x), total[x], out=np.zeros(len(total[x])), where=total[x] > 0) for x in (0, 1)]
    return out


def joint_variance_shares(tables: Tables, masses: Tables, floor: float = 1e-6) -> dict[tuple[int, ...], float]:
    """The variance of each main effect under its margin and of each pair under its joint measure."""
    out = {}
    for k, t in tables.items():
        if len(k) == 1:
            out[k] = float(_share(masses[k]) @ t**2)
        elif len(k) == 2:
            s = joint_weights(masses[k], _share(masses[(k[0],)]), _share(masses[(k[1],)]), floor)
            out[k] = float((s * t**2).sum())
    return out
