"""Rules that plain SQL over the book does not show: literal cases of ranking, binning, levels and start values."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from ratewright.operators import binning, encode, ordered, review
from ratewright.plans import boost
from ratewright.sources import model_store


def test_lift_curve_ranks_descending_and_cuts_by_floor(spark):
    rows = [(k, float(k), float(k % 3), 1.0 + k % 2) for k in range(11)]
    df = spark.createDataFrame(rows, "id int, p double, y double, w double").repartition(3)
    got = {r.bucket: r for r in review.lift_curve(df, "p", ["id"], 4, "y", "p", "w").collect()}
    order = sorted(rows, key=lambda r: -r[1])
    mean = lambda part, k: sum(r[k] * r[3] for r in part) / sum(r[3] for r in part)
    for b in range(4):
        part = order[b * 11 // 4 : (b + 1) * 11 // 4]
        assert got[b + 1].rows == len(part)
        assert got[b + 1].mean_y == pytest.approx(mean(part, 2)) and got[b + 1].mean_pred == pytest.approx(mean(part, 1))
        assert got[b + 1].lift == pytest.approx(mean(part, 2) / mean(rows, 2))
    assert review.top_bucket_lift(df, "p", ["id"], 4, "y", "p", "w").first()[0] == pytest.approx(got[1].lift)
    assert review.lift_curve(df.limit(0), "p", ["id"], 4, "y", "p", "w").count() == 0


def test_equal_mass_bands_take_ties_by_their_middle(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 1.0, 6.0), (3.0, 5.0, 1.0)], "p double, y double, w double")
    got = [tuple(r) for r in review.lift_equal_mass(df, F.col("p"), 2, "y", "w").orderBy("band").collect()]
    # middles at 0.15, 0.6 and 0.95 of the weight
    assert got == [(1, 1, 3.0, 2.0, 1.0), (2, 2, 7.0, pytest.approx(11 / 7), pytest.approx(15 / 7))]


def test_degenerate_ginis_are_zero(spark):
    df = spark.createDataFrame([(0.1, 0.0, 1.0), (0.2, -3.0, 1.0)], "p double, y double, w double")
    assert review.gini(df, F.col("p"), "y", "w").first()[0] == 0.0
    assert review.ordered_gini(df, F.col("p"), "y", "w").first()[0] == 0.0
    assert review.gini(df.limit(0), F.col("p"), "y", "w").first()[0] == 0.0


def test_dispersion_rules(spark):
    df = spark.createDataFrame([(1.0, 0.5, 2.0), (3.0, 0.0, 1.0), (2.0, 1.0, 0.0)], "y double, mu double, w double")
    assert review.dispersion(df, "poisson", "y", "mu", "w").first()[0] == pytest.approx(0.5)
    assert review.dispersion(df, "binomial", "y", "mu", "w").first()[0] == 1.0
    assert review.dispersion(df.where("mu = 0"), "poisson", "y", "mu", "w").first()[0] == 1.0


def test_exported_bins_take_nan_as_missing():
    sql = model_store.sql_bin("x", [1.0, 2.0])
    got = duckdb.sql(f"SELECT {sql} FROM (VALUES (CAST('NaN' AS DOUBLE)), (NULL), (1.0), (1.5), (9.0)) t(x)").fetchall()
    assert [r[0] for r in got] == [0, 0, 1, 2, 3]


def test_reserved_levels_are_told_apart(spark):
    df = spark.createDataFrame([(None,), ("__missing__",), ("<rare>",), ("a",)], "v string")
    levels = [r[0] for r in df.select(encode.level_of(F.col("v"))).collect()]
    assert levels[0] == "__missing__" and levels[3] == "a" and len(set(levels)) == 4 and levels[2] != "<rare>"


@pytest.mark.parametrize(("loss", "p"), [("poisson", 1.0), ("gamma", 2.0), ("tweedie", 1.5)])
def test_start_values_with_exposure(spark, loss, p):
    rows = [(float(1 + k % 4), 0.5 + k % 3, 1.0 + k % 2, float(k % 5)) for k in range(40)]
    df = spark.createDataFrame(rows, "y double, e double, w double, x double")
    model = boost.fit(df, ["x"], "y", boost.Settings(loss=loss, rounds=0), "w", "e")
    want = math.log(sum(w * y * e ** (1 - p) for y, e, w, _ in rows) / sum(w * e ** (2 - p) for y, e, w, _ in rows))
    assert model.f0 == pytest.approx(want)


def test_histogram_edges_are_interpolated_percentiles(spark):
    df = spark.range(1001).select((F.col("id") / 10 + 1).alias("v"), F.lit(1.0).alias("w"))
    low, high, log = review.histogram_edges(df, "v")
    assert (low, high, log) == (pytest.approx(1.5), pytest.approx(100.5), True)
    assert sum(r.n for r in review.histogram(df, "v", (low, high, log), 10, "w").collect()) == 1001
    assert review.histogram_edges(df.select(F.lit(2.0).alias("v")), "v") == (2.0, pytest.approx(2.2), False)


def test_running_sums_over_many_files(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), (F.col("id") % 3).alias("g"), F.lit(2).alias("x"))
    got = ordered.running(df, [F.col("k").desc()], ["x"], "g").collect()
    for g in range(3):
        own = sorted((r for r in got if r.g == g), key=lambda r: -r.k)
        assert [(r.rank, r.cum_x) for r in own] == [(i, 2 * (i + 1)) for i in range(len(own))]


def test_one_heavy_value_passes_several_shares(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 90.0), (3.0, 9.0)], "v double, w double")
    assert sorted(r[0] for r in binning.quantile_borders(df, "v", "w", 10).collect()) == [2.0]
