import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewright.errors import InputTypeError, InputValueError
from ratewright.functions import expr as X
from ratewright.operators import binning
from ratewright.plans import boost
from ratewright.sources import book, model_store


@pytest.fixture(scope="module")
def rows(spark):
    t = spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 17 == 0, None).otherwise((F.col("id") * 7 % 50).cast("double")).alias("x"),
        (F.col("id") * 3 % 11).cast("double").alias("z"),
        F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("c"),
        (0.5 + F.col("id") % 4 / 4).alias("e"),
        F.lit(1.0).alias("w"),
    )
    eta = F.when(F.col("x") > 25, 0.6).otherwise(0.0) + F.when(F.col("c") == "b", 0.4).otherwise(0.0) + F.when((F.col("x") > 25) & (F.col("z") > 5), 0.5).otherwise(0.0)
    return t.withColumn("y", F.exp(eta) * F.col("e"))


@pytest.fixture(scope="module")
def model(rows):
    return boost.fit(rows, ["x", "z", "c"], "y", boost.Settings(rounds=12, rate=0.5, max_bin=16, holdout=0.2, patience=20), weight="w", exposure="e", key="id")


def test_fit_recovers_planted_effects(rows, model):
    scored = model.score(rows)
    gap = scored.agg(F.avg(F.abs(F.col("prediction") - F.col("y") / F.col("e")))).first()[0]
    assert gap < 0.1 and model.history[-1] < model.history[0]


def test_tables_are_exact(rows, model):
    tables = boost.to_tables(model)
    constant, pure = boost.purify(tables, boost.axis_weights(rows, model))
    assert boost.check_exact(rows, model, constant, pure) < 1e-9
    weights = boost.axis_weights(rows, model)
    for axes, t in pure.items():
        for k, a in enumerate(axes):
            assert np.abs(np.tensordot(t, weights[a], ([k], [0]))).max() < 1e-8
    kept = boost.prune_tables(rows, model, constant, pure, "y", "w", 1e-6)
    assert (0,) in kept and len(kept) <= len(pure)


def test_save_load_and_sql(spark, rows, tmp_path):
    model = boost.fit(rows.where("x IS NOT NULL"), ["x", "z"], "y", boost.Settings(rounds=3, rate=0.5, max_bin=8))
    constant, pure = boost.purify(boost.to_tables(model), boost.axis_weights(rows, model))
    model_store.save(spark, f"file://{tmp_path}/m", model, pure)
    again, cells = model_store.load(spark, f"file://{tmp_path}/m")
    assert again == model and cells.count() == sum(t.size for t in pure.values())
    assert model_store.rating_export(cells).count() == len(pure)
    sql = model_store.sql_score(model, constant, pure)
    gap = model.score(rows).withColumn("s", F.expr(sql)).agg(F.max(F.abs(F.col("s") - F.col("raw")))).first()[0]
    assert gap < 1e-9


@pytest.mark.parametrize(("loss", "y"), [("squared_error", "y"), ("gamma", "y"), ("tweedie", "y"), ("logistic", "b")])
def test_losses_fit(rows, loss, y):
    data = rows.withColumn("b", (F.col("x") > 25).cast("double")).fillna({"b": 0.0})
    model = boost.fit(data, ["x"], y, boost.Settings(loss=loss, rounds=2, depth=1, max_bin=8, rate=1.0))
    assert len(model.trees) == 2


def test_monotone(rows):
    model = boost.fit(rows, ["x"], "y", boost.Settings(rounds=3, depth=1, max_bin=8, monotone={"x": -1}))
    constant, pure = boost.purify(boost.to_tables(model), boost.axis_weights(rows, model))
    assert all(np.diff(t[1:]).max() <= 1e-12 for t in pure.values())


def test_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (1.0000001,), (float("inf"),), (float("-inf"),)], "v double")
    assert [r[0] for r in df.select(X.bin_index(F.col("v"), [1.0, 2.0])).collect()] == [0, 0, 1, 2, 3, 1]
    assert binning.collapse_rare([1.0, 2.0, 3.0], [5, 1, 9, 9], 5) == [1.0, 3.0]


def test_bands_smoothing_repair():
    v, w = np.array([9.0, 1, 1.01, 5, 5.02, 0]), np.ones(6)
    assert boost.band_table(v, w, 1e-3) == [0, 1, 1, 2, 2, 3]
    assert np.diff(boost.monotone_repair(v, w, 1)[1:]).min() >= 0
    smooth = boost.graduate(v, w, 1e6)
    assert smooth[0] == 9 and np.abs(np.diff(smooth[1:], 2)).max() < 1e-3


def test_input_errors(spark, rows):
    with pytest.raises(InputValueError):
        book.select_features(rows, ["nope"])
    with pytest.raises(InputValueError):
        book.validate(rows.withColumn("e", F.lit(0.0)), "y", exposure="e")
    with pytest.raises(InputTypeError):
        book.categorical_features(rows.withColumn("a", F.array("x")), ["a"])


def test_stream(spark, rows, model, tmp_path):
    from ratewright.streaming import score

    rows.withColumn("t", F.timestamp_seconds(F.col("id") * 10)).write.parquet(f"{tmp_path}/in")
    static = spark.read.parquet(f"{tmp_path}/in")
    stream = score.monitor(score.score_stream(spark.readStream.schema(static.schema).parquet(f"{tmp_path}/in"), model), "t", "y", "1 hour", "1 hour")
    run = stream.writeStream.format("memory").queryName("ae").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert spark.table("ae").agg(F.sum("n")).first()[0] == 3000
