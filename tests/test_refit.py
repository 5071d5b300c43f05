"""Fully-corrective refit, joint re-decomposition, banding and boxes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewright.errors import InputValueError
from ratewright.operators import cooccur, joint
from ratewright.plans import banding, boost, boxes, refit


@pytest.fixture(scope="module")
def rows(spark):
    t = spark.range(4000).select(
        F.col("id"),
        F.when(F.col("id") % 19 == 0, None).otherwise((F.col("id") * 7 % 40).cast("double")).alias("x"),
        ((F.col("id") * 7 % 40) / 2 + F.col("id") * 3 % 11).cast("double").alias("z"),
        (F.col("id") * 5 % 23).cast("double").alias("v"),
        (1.0 + F.col("id") % 3).alias("w"),
        (0.5 + F.col("id") % 4 / 4).alias("e"),
    )
    eta = F.when(F.col("x") > 22, 0.7).otherwise(0.0) + F.col("z") / 30 + F.when((F.col("x") > 15) & (F.col("z") > 14), 0.6).otherwise(0.0) - F.when((F.col("v") > 9) & (F.col("z") < 9), 0.5).otherwise(0.0)
    return t.withColumn("y", F.round(F.exp(eta) * F.col("e") + F.col("id") * 13 % 7 / 6, 6)).cache()


@pytest.fixture(scope="module")
def model(rows):
    return boost.fit(rows, ["x", "z", "v"], "y", boost.Settings(rounds=10, rate=0.4, depth=2, max_bin=12), weight="w", exposure="e")


@pytest.fixture(scope="module")
def table(rows, model):
    """Bins, y, w, e of all rows as numpy."""
    binned, names = model.binned(rows)
    pdf = binned.select(*names, "y", "w", "e", "id").toPandas()
    return [pdf[n].to_numpy() for n in names], pdf


def design(model, bins):
    out = []
    for t in model.trees:
        leaf = sum(np.where(bins[s.axis] == 0, s.missing_low, bins[s.axis] <= s.bin_le).astype(int) << k for k, s in enumerate(t.splits))
        out.append(np.eye(len(t.leaves))[leaf])
    return np.hstack(out)


def test_co_occurrence_and_solver(rows, model, table):
    bins, pdf = table
    a, w = design(model, bins), pdf["w"].to_numpy()
    leaves, sizes = refit.leaf_numbers(model.trees, [F.col(n) for n in model.binned(rows)[1]])
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    cells = [F.get(F.col("leaves"), k) - int(starts[k]) for k in range(len(sizes))]
    binned = model.binned(rows)[0].withColumn("leaves", leaves)
    pairs, g, path = cooccur.normal_equations(binned, cells, sizes, F.col("w"), F.col("w") * F.col("y"))
    want = a.T @ (w[:, None] * a)
    p = np.random.default_rng(1).normal(size=len(want))
    assert np.allclose(cooccur.matrix_times(pairs, p), want @ p) and np.allclose(g, a.T @ (w * pdf["y"].to_numpy()))
    x = cooccur.solve_ridge(pairs, g, np.full(len(g), 2.0))
    assert np.allclose(x, np.linalg.solve(want + 2 * np.eye(len(g)), g), atol=1e-7)
    # Without a ridge the system is singular; what remains is a least-squares solution.
    free = cooccur.solve_ridge(pairs, g, np.zeros(len(g)))
    assert np.allclose(want @ free, g, atol=1e-4)
    cooccur.drop(rows, path)


def test_co_occurrence_of_awkward_rows(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (0, 1, None), (1, 1, 2.0)], "a int, b int, m double")
    got = cooccur.co_occurrence(df, [F.col("a"), F.col("b")], {"mass": F.col("m")}).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 0, 0, 1.0), (0, 0, 1, 1, 1.0), (0, 1, 0, 1, 2.0), (0, 1, 1, 1, 2.0), (1, 1, 1, 1, 3.0)]
    assert cooccur.co_occurrence(df.where("a > 5"), [F.col("a")], {"mass": F.col("m")}).count() == 0


@pytest.mark.parametrize("loss", ["poisson", "squared_error", "gamma", "logistic"])
def test_refit_never_raises_the_loss(rows, loss):
    df = rows.withColumn("y", F.when(F.col("y") > 2, 1.0).otherwise(0.0)) if loss == "logistic" else rows
    model = boost.fit(df, ["x", "z"], "y", boost.Settings(loss=loss, rounds=5, rate=0.3, max_bin=8), weight="w")
    new, history = refit.refit_leaves(df, model, "y", "w", l2=0.5, passes=12)
    assert all(b < a for a, b in zip(history, history[1:], strict=False)) and len(history) > 1
    assert [t.splits for t in new.trees] == [t.splits for t in model.trees]
    # At the end the penalised gradient is zero in each leaf.
    binned, names = new.binned(new.score(df))
    leaves, _ = refit.leaf_numbers(new.trees, [F.col(n) for n in names])
    pdf = binned.select(leaves.alias("l"), "raw", "y", "w").toPandas()
    raw, y, w = (pdf[c].to_numpy() for c in ("raw", "y", "w"))
    mu = {"poisson": np.exp, "gamma": np.exp, "squared_error": lambda r: r, "logistic": lambda r: 1 / (1 + np.exp(-r))}[loss](raw)
    slope = {"poisson": mu - y, "gamma": 1 - y / mu, "squared_error": mu - y, "logistic": mu - y}[loss]
    values = np.concatenate([t.leaves for t in new.trees])
    g = np.zeros(len(values))
    for at, s in zip(pdf["l"], w * slope, strict=True):
        g[np.asarray(at)] += s
    assert np.abs(g + 0.5 * values).max() < 1e-3 * w.sum() / len(values)


def test_refit_within_the_fit(rows):
    s = boost.Settings(rounds=6, rate=0.2, max_bin=8, l2=1.0)
    cost = lambda m: m.score(rows, F.ln("e")).agg(F.sum(F.col("w") * (F.col("prediction") - F.col("y") * F.col("raw")))).first()[0]
    plain = boost.fit(rows, ["x", "z"], "y", s, weight="w", exposure="e")
    better = boost.fit(rows, ["x", "z"], "y", boost.Settings(**{**s.__dict__, "refit_every": 3, "refit_l2": 1e-3}), weight="w", exposure="e")
    assert cost(better) < cost(plain) and len(better.trees) == 6


def test_refit_edges(rows, model):
    empty = rows.where("id < 0")
    assert refit.refit_leaves(empty, model, "y", "w", "e")[1] == []
    bare = boost.Model(**{**model.__dict__, "trees": []})
    assert refit.refit_leaves(rows, bare, "y", "w", "e") == (bare, [])
    with pytest.raises(InputValueError):
        refit.refit_leaves(rows.withColumn("y", F.when(F.col("id") > 0, F.col("y"))), model, "y")


# --- joint measure -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def split(rows, model):
    return boost.purify(boost.to_tables(model), boost.axis_weights(rows, model, "w"))


def test_rejoint_keeps_the_sum_and_is_pure(rows, model, split, table):
    constant, tables = split
    bins, pdf = table
    binned, names = model.binned(rows)
    sizes = [len(b) + 2 for b in model.borders]
    masses = joint.pair_masses(binned, [F.col(n) for n in names], sizes, F.col("w"))
    w = pdf["w"].to_numpy()
    want = np.zeros((sizes[0], sizes[1]))
    np.add.at(want, (bins[0], bins[1]), w)
    assert np.allclose(masses[0, 1], want) and np.allclose(masses[0,], want.sum(axis=1))
    c, out = joint.rejoint(constant, tables, masses, ridge=0.0, floor=0.0)
    total = lambda k, t: k + sum(x[tuple(bins[a] for a in axes)] for axes, x in t.items())
    assert np.abs(total(c, out) - total(constant, tables)).max() < 1e-9
    means = joint.conditional_means(out, masses)
    assert max(np.abs(m).max() for found in means.values() for m in found) < 1e-9
    assert max(np.abs(m).max() for found in joint.conditional_means(tables, masses).values() for m in found) > 1e-3
    # The defaults keep the sum too, and are pure up to what ridge and floor leave.
    c, out = joint.rejoint(constant, tables, masses)
    assert np.abs(total(c, out) - total(constant, tables)).max() < 1e-9
    assert max(np.abs(m).max() for found in joint.conditional_means(out, masses).values() for m in found) < 5e-3
    shares = joint.joint_variance_shares(out, masses)
    assert shares[0,] == pytest.approx(float((w * out[0,][bins[0]] ** 2).sum() / w.sum()))


def test_projection_solves_its_conditions():
    rng = np.random.default_rng(2)
    mass = rng.uniform(size=(6, 5)) * np.exp(-np.abs(np.arange(6)[:, None] - np.arange(5)))
    mass[3] = 0
    first, second = mass.sum(axis=1) / mass.sum(), mass.sum(axis=0) / mass.sum()
    values = rng.normal(size=(6, 5))
    s = joint.joint_weights(mass, first, second, 1e-6)
    c, a, b = joint.project(values, s, first, second, 1e-3)
    r = s * (values - c - a[:, None] - b)
    assert abs(r.sum()) < 1e-12 and a[3] == 0 and abs(first @ a) < 1e-12 and abs(second @ b) < 1e-12
    assert np.allclose(r.sum(axis=1), 1e-3 * first * a) and np.allclose(r.sum(axis=0), 1e-3 * second * b)
    none = joint.project(values, joint.joint_weights(np.zeros((6, 5)), first, second, 0.0), first, second, 0.0)
    assert np.isfinite(none[0]) and np.allclose(none[1][first > 0], ((values - none[0]) @ second)[first > 0] - none[0] * 0)


def test_rejoint_refuses(split):
    constant, tables = split
    with pytest.raises(InputValueError):
        joint.rejoint(constant, tables, {}, ridge=-1.0)
    pair = next(k for k in tables if len(k) == 2)
    with pytest.raises(InputValueError):
        joint.rejoint(0.0, {pair: tables[pair]}, {})


# --- banding -------------------------------------------------------------------------------------------------


def slow_cuts(w, s):
    groups = [[k] for k in range(1, len(w))]
    removed = []
    while len(groups) > 1:
        costs = []
        for p, q in zip(groups, groups[1:], strict=False):
            a, x, b, y = w[p].sum(0), s[p].sum(0), w[q].sum(0), s[q].sum(0)
            ok = (a > 0) & (b > 0)
            costs.append((x[ok] ** 2 / a[ok] + y[ok] ** 2 / b[ok] - (x[ok] + y[ok]) ** 2 / (a[ok] + b[ok])).sum())
        k = int(np.argmin(costs))
        removed.append(groups[k][-1])
        groups[k : k + 2] = [groups[k] + groups[k + 1]]
    return removed[::-1]


@pytest.mark.parametrize("seed", range(6))
def test_master_cuts_equal_the_quadratic_version(seed):
    rng = np.random.default_rng(seed)
    w = rng.uniform(size=(30, 9)) * (rng.uniform(size=(30, 9)) > 0.2)
    s = w * rng.normal(size=(30, 9)).cumsum(axis=0)
    assert banding.master_cuts(w, s) == slow_cuts(w, s)
    assert banding.master_cuts(w[:2], s[:2]) == [] == banding.master_cuts(w[:1], s[:1])
    steps = np.repeat([0.0, 1.0, 5.0, 5.5], [1, 10, 9, 10])[:, None] * np.ones((1, 9))
    flat = np.ones((30, 9))
    assert banding.master_cuts(flat, flat * steps)[:2] == [10, 19]
    assert banding.band_of(6, [4, 2]).tolist() == [0, 1, 1, 2, 2, 3] and banding.band_of(6, []).tolist() == [0, 1, 1, 1, 1, 1]


@pytest.mark.parametrize("sigma", [0.4, 0.05, 0.004])
def test_banding_keeps_its_budget(rows, model, split, table, sigma):
    constant, tables = split
    bins, pdf = table
    got = banding.band_pairs(rows, model, constant, tables, "y", "w", "id", sigma=sigma)
    assert got.report.budget == pytest.approx((0.75 * sigma) ** 2) and got.report.combined <= got.report.budget
    assert got.report.cells_after <= got.report.cells_before
    total = lambda k, t: k + sum(x[tuple(bins[a] for a in axes)] for axes, x in t.items())
    old, new = total(constant, tables), total(got.constant, got.tables)
    h = pdf["w"].to_numpy() * np.exp(model.f0 + old)
    assert (h * (new - old) ** 2).sum() / h.sum() <= got.report.budget * 1.1 + 1e-12
    weights = [np.bincount(b, h, len(g) + 2) for b, g in zip(bins, model.borders, strict=True)]
    for (a, b), (p, q) in got.bands.items():
        t = got.tables[a, b]
        for k in range(p.max() + 1):
            assert np.ptp(t[p == k], axis=0).max() < 1e-9
        for k in range(q.max() + 1):
            assert np.ptp(t[:, q == k], axis=1).max() < 1e-9
        assert (p == 0).sum() == (q == 0).sum() == 1
        assert np.abs(np.tensordot(t, weights[b] / weights[b].sum(), ([1], [0]))).max() < 1e-9
    plain = banding.band_pairs(rows, model, constant, tables, "y", "w", "id", sigma=sigma, distil=False)
    first = total(plain.constant, plain.tables)
    assert (h * (new - old) ** 2).sum() <= (h * (first - old) ** 2).sum() * 1.0001 + 1e-9


def test_banding_by_deviance_and_refusals(rows, model, split):
    constant, tables = split
    coarse = banding.band_pairs(rows, model, constant, tables, "y", "w", most_rise=0.05)
    fine = banding.band_pairs(rows, model, constant, tables, "y", "w", most_rise=1e-5)
    assert coarse.report.cells_after < fine.report.cells_after <= fine.report.cells_before
    assert banding.band_pairs(rows, model, constant, tables, "y", "w", sigma=0.0).report.combined < 1e-18
    with pytest.raises(InputValueError):
        banding.band_pairs(rows, model, constant, tables, "y", "w")
    with pytest.raises(InputValueError):
        banding.band_pairs(rows, model, constant, {k: t for k, t in tables.items() if len(k) == 2}, "y", "w", sigma=1.0)
    mains = {k: t for k, t in tables.items() if len(k) == 1}
    alone = banding.band_pairs(rows, model, constant, mains, "y", "w", sigma=1.0)
    assert alone.bands == {} and all(np.ptp(alone.tables[k] - t) < 1e-12 for k, t in mains.items())
    assert alone.constant + sum(t[0] for t in alone.tables.values()) == pytest.approx(constant + sum(t[0] for t in mains.values()))


# --- boxes ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_boxes_equal_dense_tables(rows, depth):
    model = boost.fit(rows, ["x", "z", "v"], "y", boost.Settings(rounds=6, rate=0.4, depth=depth, max_bin=9, least_rows=1), weight="w")
    measure = boost.axis_weights(rows, model, "w")
    constant, tables = boost.purify(boost.to_tables(model), measure)
    level, parts = boxes.factored(model, measure)
    assert level == pytest.approx(constant)
    dense = {e.axes: e.dense() for e in parts}
    for axes, t in tables.items():
        assert np.allclose(dense.get(axes, 0.0), t, atol=1e-12)
    for e in parts:
        shares = [measure[a] / measure[a].sum() for a in e.axes]
        p = shares[0]
        for s in shares[1:]:
            p = np.multiply.outer(p, s)
        assert e.variance(measure) == pytest.approx(float((p * dense[e.axes] ** 2).sum()))
    a = model.score(rows).select("id", F.col("raw").alias("want"))
    gap = boxes.score_boxes(rows, model, level, parts).join(a, "id").agg(F.max(F.abs(F.col("raw") - F.col("want")))).first()[0]
    assert gap < 1e-9


def test_four_ways_over_254_bins(spark):
    rng = np.random.default_rng(4)
    trees = [boost.Tree([boost.Split(int(a), int(rng.integers(1, 254)), bool(rng.integers(2))) for a in range(4)], rng.normal(size=16).tolist()) for _ in range(40)]
    measure = [rng.uniform(0.1, 1, 256) for _ in range(4)]
    constant, found = boxes.centred(boxes.tree_boxes(trees, [256] * 4), measure)
    assert len(found[0, 1, 2, 3]) <= 40  # one box for each tree
    parts = boxes.effects(found, measure)
    df = spark.createDataFrame(rng.integers(0, 256, (200, 4)).tolist(), "a int, b int, c int, d int")
    names = df.columns
    want = sum((t.value([F.col(n) for n in names]) for t in trees), F.lit(0.0))
    raw = F.lit(constant)
    for e in parts:
        raw = raw + boxes.effect_value(e, [F.col(names[a]) for a in e.axes])
    assert df.agg(F.max(F.abs(raw - want))).first()[0] < 1e-9
