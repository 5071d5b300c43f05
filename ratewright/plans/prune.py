"""Which tables of a bagged model to keep, judged on the rows that each bag lacks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InputValueError
from ..functions import expr as X
from ..operators import ensemble, select
from ..sources.shared import delete, new_path, written
from .boost import Model, Tables, axis_weights, in_bag, purify, to_tables


@dataclass
class Pruned:
    constant: float
    #: The centred tables of the mean model that stay.
    tables: Tables
    #: Tables in the order in which they enter after the main effects, the prefixes tried and their deviance.
    path: list[tuple[int, ...]]
    sizes: list[int]
    deviances: list[float]
    #: For ``how="vote"``: mean gain, first and second verdict of each table.
    votes: dict[tuple[int, ...], tuple[float, bool, bool]] = field(default_factory=dict)


def _variance(table: np.ndarray, axes: tuple[int, ...], measure: list[np.ndarray]) -> float:
    p = np.ones(())
    for a in axes:
        p = np.multiply.outer(p, measure[a] / measure[a].sum())
    return float((p * table**2).sum())


def _jury(axes: list[list[tuple[int, ...]]], bags: list[tuple[float, Tables]], n_features: int):
    """A function over rows (bins, base, out: a bit for each bag that lacks the row): the jury's size and the sums of each part."""

    def run(frames):
        for pdf in frames:
            bins = [pdf[f"b{k}"].to_numpy() for k in range(n_features)]
            out = pdf["out"].to_numpy()
            sums = np.zeros((len(axes), len(pdf)))
            for b, (start, tables) in enumerate(bags):
                lacks = (out >> b & 1).astype(bool)
                here = [x[lacks] for x in bins]
                for k, part in enumerate(axes):
                    value = pdf["base"].to_numpy()[lacks] + start if k == 0 else np.zeros(int(lacks.sum()))
                    for u in part:
                        if u in tables:
                            value = value + tables[u][tuple(here[a] for a in u)]
                    sums[k, lacks] += value
            jury = np.array([int(x).bit_count() for x in out], np.int64)
            yield pd.DataFrame({"fold": pdf["fold"], "y": pdf["y"], "w": pdf["w"], "jury": jury, **{f"s{k}": x for k, x in enumerate(sums)}})

    return run


def prune(df: DataFrame, mean: Model, models: list[Model], y: str, weight: str | None = None, exposure: str | None = None, key: str = "id", share: float = 0.8, how: str = "path", steps: int = 12, fraction: float = 0.995, tolerance: float = 0.001, folds: int = 5, z: float = 2.0, least_gain: float = 0.0, stability: float = 0.5, budget: int = 1_000) -> Pruned:
    """The tables of ``mean`` that stay, judged by the bags ``models`` of :func:`ratewright.plans.boost.fit_bags` (same key, share and seed).

    Each row is scored by the bags that lack it.  ``how="path"``: tables enter by falling variance, tables of three features after their pairs, and the first
    prefix with ``fraction`` of the best fall of the deviance and within ``tolerance`` of the best stays.  ``how="vote"``: each fold of the keys chooses its own
    prefix and says what each table gains it, and the tables that pass the votes stay, with their main effects.  All prefixes and drops come from one pass.
    Rows that every bag holds are left out; without any other row nothing is dropped.
    """
    if how not in ("path", "vote"):
        raise InputValueError(f"unknown way to prune: {how}")
    s = mean.settings
    measure = axis_weights(df, mean, weight)
    constant, tables = purify(to_tables(mean), measure)
    own = [purify(to_tables(m), measure) for m in models]
    bags = [(m.f0 + c, t) for m, (c, t) in zip(models, own, strict=True)]
    name = lambda u: frozenset(mean.features[a] for a in u)
    by_name = {name(u): u for u in tables}
    stay, path, sizes = select.ranked_sequence({name(u): _variance(t, u, measure) for u, t in tables.items()}, steps)
    order = [by_name[u] for u in path]
    # A part for each table of the path: prefixes and drops are sums of parts.
    axes = [[by_name[u] for u in stay], *[[u] for u in order]]
    w, e = F.col(weight).cast("double") if weight else F.lit(1.0), F.col(exposure).cast("double") if exposure else F.lit(1.0)
    offset = F.ln(e) if X.LINKS[s.loss] == "log" else F.lit(0.0)
    out: Column = F.lit(0)
    for b in range(len(models)):
        out = out + F.when(in_bag(key, b, share, s.seed), 0).otherwise(1 << b)
    binned, names = mean.binned(df.select(*mean.features, F.col(y).cast("double").alias("_y"), w.alias("_w"), offset.alias("_base"), out.cast("long").alias("_out"), F.pmod(F.xxhash64(F.lit("fold"), F.col(key)), F.lit(folds)).cast("int").alias("_fold")))
    rows = binned.where("_out > 0").select(*[F.col(n).cast("int").alias(f"b{k}") for k, n in enumerate(names)], F.col("_y").alias("y"), F.col("_w").alias("w"), F.col("_base").alias("base"), F.col("_out").alias("out"), F.col("_fold").alias("fold"))
    parts = [f"s{k}" for k in range(len(axes))]
    scratch = new_path(df.sparkSession, "juries")
    juries = written(rows.mapInPandas(_jury(axes, bags, len(names)), "fold int, y double, w double, jury long, " + ", ".join(f"{p} double" for p in parts)), scratch)
    try:
        if juries.isEmpty():
            return Pruned(constant, tables, order, sizes, [])
        found = {r["prefix"]: r["deviance"] for r in ensemble.prefix_deviances(juries, parts, s.loss, "y", "w", s.power).collect()}
        deviances = [found[k] for k in sizes]
        kept = {u for u in stay} | set(path[: sizes[select.chosen_prefix(deviances, fraction, tolerance)]])
        votes = {}
        if how == "vote":
            votes = _votes(juries, parts, path, sizes, mean, folds, fraction, tolerance, z, least_gain, stability)
            kept = select.voted(votes, by_name, budget)
        return Pruned(constant, {u: t for u, t in tables.items() if name(u) in kept}, order, sizes, deviances, {by_name[u]: v for u, v in votes.items()})
    finally:
        delete(df.sparkSession, scratch)


def _votes(juries: DataFrame, parts: list[str], path: list, sizes: list[int], mean: Model, folds: int, fraction: float, tolerance: float, z: float, least_gain: float, stability: float) -> dict:
    """Mean gain and both verdicts of each table on the path; a fold's gain of a table is what its deviance rises without it."""
    s = mean.settings
    shares = {p: F.col(p) / F.col("jury") for p in parts}
    label = {f"t{k}": u for k, u in enumerate(path)}
    gains = ensemble.drop_gains(juries, "fold", shares["s0"], {f"t{k}": shares[p] for k, p in enumerate(parts[1:])}, s.loss, "y", "w", s.power) if path else None
    if gains is None:
        return {}
    kept = []
    for r in juries.select("fold").distinct().collect():  # at most ``folds`` rows
        found = {x["prefix"]: x["deviance"] for x in ensemble.prefix_deviances(juries.where(F.col("fold") == r["fold"]), parts, s.loss, "y", "w", s.power).collect()}
        chosen = sizes[select.chosen_prefix([found[k] for k in sizes], fraction, tolerance)]
        kept += [(r["fold"], f"t{k}", k < chosen) for k in range(len(path))]
    verdicts = juries.sparkSession.createDataFrame(kept, "fold int, table_id string, kept boolean")
    rows = ensemble.fold_votes(gains.join(F.broadcast(verdicts), ["fold", "table_id"]), folds, least_gain, stability, z).collect()
    return {label[r["table_id"]]: (r["mean_gain"], r["legacy_keep"], r["evidence_keep"]) for r in rows}
