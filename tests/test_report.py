"""Literal cases of credibility, bands, quantiles, splits, smoothing, selection and holdouts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewright.errors import InputValueError
from ratewright.operators import binning, credibility, encode, report, select, tables, training


def test_cell_groups_end_one_band_a_cell():
    assert report.cell_groups([1.0, 1, 1, 1]) == [0, 1, 2, 3]
    # the second cell passes several shares and still ends one band only
    assert report.cell_groups([0.0, 1, 90, 3, 3, 3], 4) == [0, 1, 1, 2, 3, 3]
    assert report.cell_groups([0.0, 5, 9, 1, 7, 1], 4, categorical=True) == [0, 3, 1, 3, 2, 3]
    assert report.cell_groups([2.0, 0, 0, 0, 0], 3) == [0, 1, 1, 1, 1]


def test_cell_groups_equal_a_walk_over_the_cells():
    rng = np.random.default_rng(3)
    for _ in range(200):
        mass = rng.integers(0, 4, rng.integers(2, 40)).astype(float) ** rng.integers(1, 5)
        most = int(rng.integers(3, 12))
        own, room = mass[1:], most - 1
        if len(own) <= room or own.sum() <= 0:
            continue
        want, band, held = [0], 1, 0.0
        for m in own:
            want.append(band)
            held += m
            if band < room and held >= own.sum() * band / room:
                band += 1
        assert report.cell_groups(mass.tolist(), most) == want


def test_quantile_on_a_boundary_is_averaged(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (8.0, 4.0), (None, 9.0)], "v double, w double")
    got = {r.share: r.value for r in binning.weighted_quantiles(df, "v", "w", [0.25, 0.3, 0.5, 1.0]).collect()}
    assert got == {0.25: 2.0, 0.3: 3.0, 0.5: 5.5, 1.0: 8.0}
    assert binning.weighted_quantiles(df.limit(0), "v", "w", [0.5]).first().value is None


def test_percentiles_equal_numpy(spark):
    values = [float(k * 37 % 101) / 7 for k in range(500)]
    df = spark.createDataFrame([(v,) for v in [*values, math.nan]] + [(None,)], "v double").repartition(3)
    got = {r.share: r.value for r in report.percentiles(df, "v", [0.01, 0.5, 0.99]).collect()}
    assert got == pytest.approx({q: np.percentile(values, 100 * q) for q in got})
    assert report.percentiles(df.limit(0), "v", [0.5]).count() == 0


def test_sampled_lorenz_has_every_point(spark):
    df = spark.createDataFrame([(float(k), float(k % 4), 1.0 + k % 3) for k in range(7)], "p double, y double, w double")
    got = {round(r.x, 2): r.y for r in report.sampled_lorenz(df, F.col("p"), "y", "w", 11).collect()}
    w, wy = np.array([1.0 + k % 3 for k in range(7)]), np.array([(1.0 + k % 3) * (k % 4) for k in range(7)])
    x, y = np.r_[0, np.cumsum(w) / w.sum()], np.r_[0, np.cumsum(wy) / wy.sum()]
    assert got == pytest.approx({round(k / 10, 2): float(np.interp(k / 10, x, y)) for k in range(11)})


def test_strength_without_signal_and_without_noise(spark):
    flat = spark.createDataFrame([(str(k % 5), float(k % 2), 1.0, 1.0) for k in range(40)], "c string, y double, w double, e double")
    assert credibility.auto_strength(flat, "c", "y", "w", "e").first()[0] == 1e6
    exact = spark.createDataFrame([(str(k % 5), float(k % 5), 1.0, 1.0) for k in range(40)], "c string, y double, w double, e double")
    assert credibility.auto_strength(exact, "c", "y", "w", "e").first()[0] == 0.0
    assert credibility.auto_strength(flat.limit(0), "c", "y", "w", "e").first()[0] is None


def test_unseen_levels_by_policy(spark):
    df = spark.createDataFrame([("a", 1.0, 9.0, 1.0), ("b", 2.0, 1.0, 1.0)], "c string, y double, w double, e double")
    known = encode.fixed_encoding(df, "c", "y", "w", "e", 0.0, 2.0)
    rows = spark.createDataFrame([("a",), ("new",)], "c string")
    value = lambda unseen: {r.c: r.encoding for r in credibility.serve_encoding(rows, "c", known, 7.0, unseen).collect()}
    assert value("default") == {"a": 1.0, "new": 7.0} and value("rare") == {"a": 1.0, "new": 2.0}
    with pytest.raises(InputValueError, match="new"):
        value("error")


def test_missing_alone_is_a_split(spark):
    hist = spark.createDataFrame([(0, 0, 0, -8.0, 4.0), (0, 0, 1, 4.0, 2.0), (0, 0, 2, 4.0, 2.0)], "leaf int, axis int, bin int, g double, h double")
    best = training.best_of_all_splits(training.all_split_gains(hist, 0.0)).first()
    assert (best.bin_le, best.missing_low) == (0, True) and best.gain == pytest.approx(16.0)


def test_sign_coefficients_rebuild_the_leaves(spark):
    values = [3.0, -1.0, 4.0, 1.5, -5.0, 9.0, 2.0, 6.0]
    df = spark.createDataFrame(list(enumerate(values)), "leaf int, value double")
    c = {r.mask: r.coefficient for r in training.sign_coefficients(df).collect()}
    assert [sum(v * (-1) ** bin(m & leaf).count("1") for m, v in c.items()) for leaf in range(8)] == pytest.approx(values)


def test_logit_shift_with_far_scores(spark):
    rows = [(float(k % 3 == 0), (-40.0, 0.0, 35.0)[k % 3] + k / 50, 1.0 + k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "y double, s double, w double")
    c = credibility.logit_shift(df, "y", F.col("s"), "w").first()[0]
    assert sum(w * (y - 1 / (1 + math.exp(-(c + s)))) for y, s, w in rows) == pytest.approx(0, abs=1e-6)
    assert credibility.logit_shift(df.withColumn("y", F.lit(1.0)), "y", F.col("s"), "w").first()[0] is None


def test_joint_variance_sees_covariance(spark):
    df = spark.createDataFrame([(1.0, 2.0), (-1.0, -2.0)], "a double, b double")
    got = {r.table_id: r.variance for r in tables.joint_variance(df, {"a": F.col("a"), "a:b": F.col("b")}, F.lit(1.0)).collect()}
    assert got == {"a": 1.0, "a:b": 4.0, "*": 9.0}
    parts = {r.feature: r.importance for r in tables.feature_importances(spark.createDataFrame(list(got.items()), "table_id string, variance double")).collect()}
    assert parts == pytest.approx({"a": 0.6, "b": 0.4})


def test_selection_keeps_the_subsets_of_strong_tables():
    a, b, ab, c, bc = (frozenset(x) for x in ("a", "b", "ab", "c", "bc"))
    variances = {a: 0.0, b: 0.1, ab: 10.0, c: 0.0, bc: 0.001}
    assert select.kept_by_share(variances, 0.05, keep_mains=False) == {a, b, ab}
    assert select.kept_by_share(variances, 0.05) == {a, b, ab, c}
    assert select.maximal(variances) == {ab, bc}


def test_prefix_choice():
    path = [10.0, 6.0, 5.2, 5.0, 5.5]
    assert select.chosen_prefix(path) == 3
    assert select.chosen_prefix(path, 0.9, 1.0) == 2 and select.chosen_prefix(path, 0.5, 0.01) == 3
    assert select.chosen_prefix([1.0, 2.0], 0.5) == 0


def test_holdout_sizes_and_whole_groups(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    held = report.holdout(df, ["id"], 0.25, 1, F.col("g")).join(df, "id").where("held").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in held} == {0: 8, 1: 8, 2: 8}
    assert report.group_holdout(df, "g", 0.5, 1).where("held").count() == 1
