"""Co-occurrence of the cells of many tables, and ridge systems over them.

A row lies in one cell of each table (a leaf of each tree, a cell of each effect).  What least squares over such cells needs of
the rows is, for each two tables, the mass of each pair of cells: one shuffle, with sums before it.  The system is then
solved by conjugate gradients whose products are aggregates over that sparse table of pairs; the driver holds vectors only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import delete, new_path, written


def co_occurrence(df: DataFrame, cells: Sequence[Column], masses: dict[str, Column]) -> DataFrame:
    """t, c, u, d and the sums of ``masses`` over rows in cell c of table t and cell d of table u, for t <= u (numbers of ``cells``).

    Rows that lie in the same cells of all tables are summed first; null masses count as 0.
    """
    names = list(masses)
    alike = df.select(F.array(*[c.cast("int") for c in cells]).alias("cells"), *[F.coalesce(m.cast("double"), F.lit(0.0)).alias(n) for n, m in masses.items()])
    alike = alike.groupBy("cells").agg(*[F.sum(n).alias(n) for n in names])
    first = alike.select("cells", *names, F.posexplode("cells").alias("t", "c"))
    pairs = first.select("t", "c", *names, F.posexplode(F.slice("cells", F.col("t") + 1, F.size("cells"))).alias("k", "d"))
    return pairs.groupBy("t", "c", (F.col("t") + F.col("k")).alias("u"), "d").agg(*[F.sum(n).alias(n) for n in names])


def cell_sums(df: DataFrame, cells: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """t, c and the sums of ``values`` over the rows in cell c of table t."""
    rows = df.select(F.posexplode(F.array(*[c.cast("int") for c in cells])).alias("t", "c"), *[v.cast("double").alias(n) for n, v in values.items()])
    return rows.groupBy("t", "c").agg(*[F.sum(n).alias(n) for n in values])


def _product(p: np.ndarray):
    """A function over batches of pairs (i, j, v with i <= j): parts of the product with ``p``, a row for each unknown."""

    def run(batches):
        total = np.zeros(len(p))
        for batch in batches:
            i, j, v = (batch.column(k).to_numpy() for k in ("i", "j", "v"))
            total += np.bincount(i, v * p[j], len(p))
            off = i != j
            total += np.bincount(j[off], v[off] * p[i[off]], len(p))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["i", "x"])

    return run


def matrix_times(pairs: DataFrame, p: np.ndarray) -> np.ndarray:
    """The symmetric matrix of ``pairs`` (i <= j int, v double) times a vector: one aggregate over the pairs."""
    out = np.zeros(len(p))
    for r in pairs.select("i", "j", "v").mapInArrow(_product(p), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r["i"]] = r["x"]
    return out


def solve_ridge(pairs: DataFrame, rhs: np.ndarray, ridge: np.ndarray, tolerance: float = 1e-10, most: int = 500) -> np.ndarray:
    """x with (A + diag(ridge)) x = rhs by preconditioned conjugate gradients; A is the matrix of ``pairs``.

    Unknowns that no pair names and no ridge holds stay 0.  Each step is one pass over the pairs, which should be a written table.
    """
    diagonal = np.zeros(len(rhs))
    for r in pairs.where("i = j").select("i", "v").collect():  # a row for each unknown
        diagonal[r["i"]] = r["v"]
    scale = diagonal + ridge
    free = scale > 0
    inverse = np.divide(1.0, scale, out=np.zeros_like(scale), where=free)
    x, residual = np.zeros(len(rhs)), np.where(free, rhs, 0.0)
    z = inverse * residual
    p, rz, stop = z.copy(), float(residual @ z), 0.0
    stop = tolerance**2 * rz
    for _ in range(most):
        if rz <= stop:
            break
        ap = matrix_times(pairs, p) + ridge * p
        curve = float(p @ ap)
        if curve <= 0:
            break  # only rounding is left
        x += rz / curve * p
        residual = np.where(free, residual - rz / curve * ap, 0.0)
        z = inverse * residual
        rz, old = float(residual @ z), rz
        p = z + rz / old * p
    return x


def normal_equations(df: DataFrame, cells: Sequence[Column], sizes: Sequence[int], h: Column, g: Column) -> tuple[DataFrame, np.ndarray, str]:
    """(pairs, gradient, path): the curvature of pairs of cells as i <= j, v in a written table, sums of ``g`` by cell, the table's folder.

    Cells of table t are numbered from the sum of ``sizes`` before it.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    first = F.array(*[F.lit(int(s)) for s in starts])
    at = lambda t, c: (F.get(first, F.col(t)) + F.col(c)).cast("int")
    path = new_path(df.sparkSession, "pairs")
    pairs = written(co_occurrence(df, cells, {"mass": h}).select(at("t", "c").alias("i"), at("u", "d").alias("j"), F.col("mass").alias("v")), path)
    gradient = np.zeros(starts[-1])
    for r in cell_sums(df, cells, {"g": g}).select(at("t", "c").alias("i"), "g").collect():  # a row for each unknown
        gradient[r["i"]] = r["g"]
    return pairs, gradient, path


def drop(df: DataFrame, path: str) -> None:
    """Delete a table that :func:`normal_equations` wrote."""
    delete(df.sparkSession, path)
