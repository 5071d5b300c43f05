"""Row sampling, dropout and momentum in the fit."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewright.errors import InputValueError
from ratewright.operators import ensemble
from ratewright.plans import boost


@pytest.fixture(scope="module")
def rows(spark):
    t = spark.range(3000).select("id", (F.col("id") * 7 % 30).cast("double").alias("x"), (F.col("id") * 11 % 13).cast("double").alias("z"), (1.0 + F.col("id") % 2).alias("w"))
    return t.withColumn("y", F.when(F.col("x") > 12, 3.0).otherwise(1.0) + F.col("z") / 6 + (F.col("id") * 17 % 5) / 10).cache()


def fitted(rows, **more):
    return boost.fit(rows, ["x", "z"], "y", boost.Settings(**{"loss": "squared_error", "rounds": 3, "rate": 0.5, "depth": 1, "l2": 1.0, "max_bin": 8, **more}), weight="w", key="id")


def loss(model, rows):
    return model.score(rows).agg(F.sum(F.col("w") * (F.col("raw") - F.col("y")) ** 2)).first()[0]


def by_hand(rows, model, rates, at_of):
    """The leaves of given splits, round by round, at the scores that ``at_of`` names."""
    binned, names = model.binned(rows)
    pdf = binned.select(*names, "y", "w").toPandas()
    y, w, bins = pdf["y"].to_numpy(), pdf["w"].to_numpy(), [pdf[n].to_numpy() for n in names]
    values = []
    for k, t in enumerate(model.trees):
        (s,) = t.splits
        leaf = np.where(bins[s.axis] == 0, s.missing_low, bins[s.axis] <= s.bin_le).astype(int)
        at = at_of(k, values, y)
        newton = np.array([rates * (w[leaf == i] * (y - at)[leaf == i]).sum() / (w[leaf == i].sum() + 1.0) for i in (0, 1)])
        values.append((leaf, newton))
    return values


def test_draw_is_a_function_of_the_key(spark):
    got = spark.range(2000).select(ensemble.draw(F.col("id"), "a|3").alias("u")).collect()
    assert got[5].u == int(hashlib.md5(b"a|3|5").hexdigest()[:13], 16) / 2**52
    assert abs(np.mean([r.u for r in got]) - 0.5) < 0.02 and 0 <= min(r.u for r in got) and max(r.u for r in got) < 1


def test_drawn_sums_are_unbiased(rows):
    g = F.col("y") - 2.6
    want = rows.agg(F.sum(F.abs(g)), F.sum(F.when(g != 0, F.col("w") * g))).first()
    found, sizes = [], []
    for seed in range(20):
        r = ensemble.drawn_rows(rows, g, 0.2, F.col("id"), str(seed)).agg(F.count("*"), F.sum(F.col("inverse") * F.abs(g)), F.sum(F.col("inverse") * F.col("w") * g)).first()
        sizes.append(r[0])
        found.append(r[1:])
    assert abs(np.mean(sizes) - 600) < 25
    assert abs(np.mean([a for a, _ in found]) / want[0] - 1) < 0.02 and abs(np.mean([b for _, b in found]) - want[1]) < 0.05 * want[0]
    again = [sorted(r.id for r in ensemble.drawn_rows(rows.repartition(n), g, 0.2, F.col("id"), "0").select("id").collect()) for n in (1, 5)]
    assert again[0] == again[1]
    assert ensemble.drawn_rows(rows, F.lit(0.0), 0.2, F.col("id"), "0").count() == 0
    assert ensemble.drawn_rows(rows, g, 0.001, F.col("id"), "0", least=3000).count() > 2900
    assert ensemble.drawn_rows(rows.where("id < 0"), g, 0.2, F.col("id"), "0").count() == 0


def test_sampled_fit_takes_its_leaves_from_all_rows(rows):
    model = fitted(rows, sample=0.3, sample_least=10)
    assert loss(model, rows) < 1.2 * loss(fitted(rows), rows)
    total = lambda k, values: sum((v[leaf] for leaf, v in values), np.full(3000, model.f0))
    for t, (_, v) in zip(model.trees, by_hand(rows, model, 0.5, lambda k, values, y: total(k, values)), strict=True):
        assert np.allclose(t.leaves, v)
    with pytest.raises(InputValueError):
        boost.fit(rows, ["x"], "y", boost.Settings(sample=0.5))


def test_dropout_by_hand(rows):
    chance, seed = 0.6, 5
    model = fitted(rows, dropout=chance, seed=seed, rounds=4)
    drops = [boost.dropped_trees(k, chance, seed, k) for k in range(4)]
    assert any(drops) and len(model.trees) == 4
    scale = []

    def at(k, values, y):
        return sum((scale[i] * v[leaf] for i, (leaf, v) in enumerate(values) if i not in drops[k]), np.full(len(y), model.f0))

    def step(k, values, y):
        if k:  # what the round before did to the shares
            d = len(drops[k - 1])
            for i in drops[k - 1]:
                scale[i] *= d / (d + 1)
            scale.append(1 / (d + 1))
        return at(k, values, y)

    values = by_hand(rows, model, 0.5, step)
    d = len(drops[3])
    for i in drops[3]:
        scale[i] *= d / (d + 1)
    scale.append(1 / (d + 1))
    for t, s, (_, v) in zip(model.trees, scale, values, strict=True):
        assert np.allclose(t.leaves, s * v)


def test_momentum_by_hand(rows):
    model = fitted(rows, momentum=True)
    shares = [[1.0], [1.0, 1.0], [1.0, 1.25, 1.0]]  # of the trees in the scores after each round
    # after round 0: f = v0, a = v0; round 1 at v0: f = v0 + v1, a = v0 + 1.5 v1; round 2 at v0 + 1.25 v1.
    starts = [[], [1.0], [1.0, 1.25]]
    at = lambda k, values, y: sum((s * v[leaf] for s, (leaf, v) in zip(starts[k], values, strict=True)), np.full(len(y), model.f0))
    for t, s, (_, v) in zip(model.trees, shares[2], by_hand(rows, model, 0.5, at), strict=True):
        assert np.allclose(t.leaves, s * v)
    with pytest.raises(InputValueError):
        fitted(rows, momentum=True, dropout=0.5)


def test_the_best_round_is_kept(rows):
    for more in ({"dropout": 0.4}, {"momentum": True}, {"refit_every": 2}):
        model = fitted(rows, rounds=6, holdout=0.3, patience=6, **more)
        assert 1 <= len(model.trees) <= 6 and len(model.history) <= 6
        held = rows.where(F.pmod(F.xxhash64("id"), F.lit(10_000)) < 3000)
        now = model.score(held).agg(F.sum(F.col("w") * (F.col("raw") - F.col("y")) ** 2) / F.sum("w")).first()[0]
        assert now == pytest.approx(min(model.history))


@pytest.fixture(scope="module")
def labelled(rows):
    level = F.when(F.col("id") % 23 == 0, None).otherwise(F.concat(F.lit("l"), (F.col("id") * 7 % 150).cast("string")))
    return rows.withColumns({"c": level, "y": F.col("y") + (F.col("id") * 7 % 150) / 50})


def test_levels_as_a_table_equal_levels_as_a_map(spark, labelled, monkeypatch, tmp_path):
    from ratewright.sources import model_store

    more = {"rounds": 3, "depth": 2, "max_bin": 200, "loss": "squared_error"}
    small = boost.fit(labelled, ["x", "c"], "y", boost.Settings(**more), weight="w")
    monkeypatch.setattr(boost, "MAP_LEVELS", 20)
    large = boost.fit(labelled, ["x", "c"], "y", boost.Settings(**more), weight="w")
    assert isinstance(large.levels["c"], str) and len(small.levels["c"]) == 151
    other = labelled.union(labelled.limit(3).withColumn("c", F.lit("new")))
    a, b = (sorted(r.prediction for r in m.score(other).select("prediction").collect()) for m in (small, large))
    assert np.allclose(a, b)
    assert large.score(other).columns == [*other.columns, "raw", "prediction"]
    constant, tables = boost.purify(boost.to_tables(large), boost.axis_weights(labelled, large, "w"))
    assert boost.check_exact(other, large, constant, tables) < 1e-9
    model_store.save(spark, str(tmp_path / "m"), large, tables)
    again, _ = model_store.load(spark, str(tmp_path / "m"))
    assert str(tmp_path) in again.levels["c"]
    assert np.allclose(sorted(r.prediction for r in again.score(other).select("prediction").collect()), b)


def test_out_of_fold_encodings_do_not_see_their_rows(spark):
    # Each level has two rows and says nothing: in-sample encodings fit the noise, those without a row's fold cannot.
    noise = spark.range(2000).select("id", (F.col("id") / 2).cast("int").cast("string").alias("c"), F.lit(1.0).alias("w"), F.rand(3).alias("y"))
    noise = noise.union(noise).where("id >= 0").persist()
    settings = {"loss": "squared_error", "rounds": 3, "rate": 0.5, "strength": 0.1}
    plain = boost.fit(noise, ["c"], "y", boost.Settings(**settings), weight="w", key="id")
    folded = boost.fit(noise, ["c"], "y", boost.Settings(**settings, folds=5), weight="w", key="id")
    spread = lambda m: float(np.std([v for t in m.trees for v in t.leaves])) if m.trees else 0.0
    assert spread(folded) < 0.5 * spread(plain)
    with pytest.raises(InputValueError):
        boost.fit(noise, ["c"], "y", boost.Settings(folds=5))


def test_out_of_fold_fit_still_learns(labelled):
    model = boost.fit(labelled, ["x", "c"], "y", boost.Settings(loss="squared_error", rounds=8, rate=0.5, folds=4, holdout=0.2), weight="w", key="id")
    assert model.history[-1] < 0.5 * model.history[0]


@pytest.fixture(scope="module")
def product(spark):
    """A product of four signs, and one main effect (six probes of the order cap)."""
    n = spark.range(4000).select("id", *[(F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(1000)) / 500 - 1).alias(f"n{k}") for k in range(5)])
    sign = lambda k: F.signum(f"n{k}")
    return n.withColumns({"y": sign(0) * sign(1) + 0.8 * sign(4) + 0.4 * sign(0) * sign(1) * sign(2), "w": F.lit(1.0)}).cache()


NAMES = [f"n{k}" for k in range(5)]


def orders(product, **more):
    model = boost.fit(product, NAMES, "y", boost.Settings(**{"loss": "squared_error", "rounds": 4, "rate": 0.5, "depth": 3, "max_bin": 4, **more}), weight="w")
    return [{s.axis for s in t.splits} for t in model.trees]


def test_order_and_groups(product):
    assert max(map(len, orders(product))) == 3
    assert max(map(len, orders(product, order=1))) == 1 and max(map(len, orders(product, order=2))) == 2
    apart = orders(product, groups=[["n0", "n1"], ["n2"], ["n3"], ["n4"]])
    assert all(len(t) == 1 or t == {0, 1} for t in apart)


def test_hurdle(product):
    assert max(map(len, orders(product, hurdle=1e6))) == 1
    assert max(map(len, orders(product, hurdle=1e-6, adaptive=True))) > 1
    s = boost.Settings(hurdle=0.4, adaptive=True, memory=0.9)
    grown = boost.Growth(NAMES, s)
    assert grown.floor(1, []) == 0.0 and grown.floor(1, [10.0]) == pytest.approx(4.0)
    assert grown.floor(2, [10.0, 30.0]) == pytest.approx(12.0) and grown.floor(2, [10.0, 5.0]) == pytest.approx(8.0) and grown.floor(3, [10.0, 1.0, 1.0]) == pytest.approx(16.0)
    grown.grown([boost.Split(0, 1, False)], [40.0])
    assert grown.floor(1, [10.0]) == pytest.approx(0.4 * (0.25 + 0.75 * 0.5) * 10)
    grown.grown([], [1.0])
    assert grown.first == pytest.approx(36.0)
    assert boost.Growth(NAMES, boost.Settings(hurdle=0.4)).floor(3, [10.0, 1.0, 1.0]) == pytest.approx(4.0)


def test_table_budget_ranks_but_does_not_bar(product):
    grown = boost.Growth(NAMES, boost.Settings(table_cells=8, table_power=0.5))
    grown.grown([boost.Split(0, 1, False), boost.Split(0, 2, False)], [1.0])
    weight = grown.rank({0})
    assert weight(0, 1) == 1.0 and weight(0, 3) == 1.0 and weight(1, 1) == pytest.approx((8 / 12) ** 0.5)
    assert boost.Growth(NAMES, boost.Settings()).rank({0}) is None
    assert boost.Growth(NAMES, boost.Settings(table_cells=27, depth=4)).rank({0, 1, 2})(3, 1) == pytest.approx((13.5 / 24) ** 0.5)
    assert max(map(len, orders(product, table_cells=1, table_power=20.0))) < 3


def test_threshold_bound_and_smoothing(product):
    plain, soft, bound = (boost.fit(product, NAMES, "y", boost.Settings(loss="squared_error", rounds=1, rate=1.0, depth=1, max_bin=4, l2=0.0, **m), weight="w").trees[0] for m in ({}, {"l1": 200.0}, {"most_step": 0.3}))
    n = product.count()
    assert plain.splits == soft.splits
    assert all(abs(a) > abs(b) > 0 for a, b in zip(plain.leaves, soft.leaves, strict=True)) and sum(abs(a - b) for a, b in zip(plain.leaves, soft.leaves, strict=True)) == pytest.approx(400 / (n / 2), rel=0.1)
    assert max(map(abs, bound.leaves)) == pytest.approx(0.3)
    smooth = boost.fit(product, NAMES, "y", boost.Settings(loss="squared_error", rounds=1, rate=1.0, depth=1, max_bin=4, l2=0.0, smoothing=2000.0), weight="w").trees[0]
    assert smooth.splits == plain.splits and all(0 < b / a < 0.6 for a, b in zip(plain.leaves, smooth.leaves, strict=True))
