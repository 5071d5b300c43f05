from pyspark.sql import functions as F

from ratewright.plans import boost


def test_missing_against_present_is_one_split(spark):
    rows = spark.range(600).select(F.when(F.col("id") % 3 != 0, (F.col("id") % 7).cast("double")).alias("x"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(1.0).alias("y"))
    model = boost.fit(rows, ["x"], "y", boost.Settings(loss="squared_error", rounds=1, depth=1, rate=1.0, l2=0.0, monotone={"x": 1}))
    assert [t.splits for t in model.trees] == [[boost.Split(0, 0, True)]]
    assert {(r.y, round(r.prediction, 9)) for r in model.score(rows).collect()} == {(5.0, 5.0), (1.0, 1.0)}
    constant, tables = boost.purify(boost.to_tables(model), boost.axis_weights(rows, model))
    assert boost.check_exact(rows, model, constant, tables) < 1e-9
