import numpy as np
from pyspark.sql import functions as F

from ratewright.functions import expr as X
from ratewright.operators import ensemble, rules, select
from ratewright.plans import boost


def book(spark, n=1200):
    t = spark.range(n).select("id", (F.col("id") * 7 % 40).cast("double").alias("x"), F.concat(F.lit("k"), (F.col("id") * 11 % 90).cast("string")).alias("c"), F.lit(1.0).alias("w"))
    return t.withColumn("y", F.exp(F.when(F.col("x") > 20, 0.7).otherwise(0.0) + F.substring("c", 2, 2).cast("double") / 60))


def test_levels_are_dealt_evenly_to_bins(spark):
    rows = book(spark)
    borders, levels, _ = boost._grids(rows.withColumns({"_y": F.col("y"), "_e": F.col("w")}), ["c"], "_y", "w", "_e", boost.Settings(max_bin=9))
    values = np.unique(np.array(list(levels["c"].values()), np.float32))
    counts = np.bincount(np.searchsorted(borders[0], values))
    assert len(values) > 9 and len(borders[0]) == 8 and counts.max() - counts.min() <= 1


def test_mean_of_bags_is_exact(spark):
    rows = book(spark).withColumns({"_b0": F.lit("mine"), "raw": F.lit(-1.0)})
    s = boost.Settings(rounds=4, rate=0.5, max_bin=8, depth=1, decay=0.1, columns=0.5, seed=3)
    mean, models = boost.fit_bags(rows, ["x", "c"], "y", s, key="id", bags=3)
    assert len(models) == 3 and len(mean.trees) == sum(len(m.trees) for m in models)
    parts = mean.score(rows).select("id", "_b0", F.col("raw").alias("mean"))
    for k, m in enumerate(models):
        parts = parts.join(m.score(rows).select("id", F.col("raw").alias(f"r{k}")), "id")
    gap = parts.agg(F.max(F.abs(F.col("mean") - (F.col("r0") + F.col("r1") + F.col("r2")) / 3)), F.min("_b0")).first()
    assert gap[0] < 1e-9 and gap[1] == "mine"
    share = rows.agg(F.avg(boost.in_bag("id", 0, 0.8).cast("double")), F.avg((boost.in_bag("id", 0, 0.8) & boost.in_bag("id", 1, 0.8)).cast("double"))).first()
    assert abs(share[0] - 0.8) < 0.05 and abs(share[1] - 0.64) < 0.06


def test_corrections_equal_dense_regression(spark):
    rows = book(spark).withColumns({"a": (F.col("id") % 4).cast("int"), "b": (F.col("id") * 3 % 5).cast("int"), "s": F.col("id") % 3 / 10})
    g, h = X.grad_hess("poisson", F.col("y"), F.col("s"))
    got = {(r["table_id"], r["cell"]): r["delta"] for r in ensemble.cell_corrections(rows, {"a": F.col("a"), "b": F.col("b")}, g, h, "w", 2.0).collect()}
    p = rows.select("a", "b", g.alias("g"), h.alias("h")).toPandas()
    x = np.concatenate([np.eye(4)[p.a], np.eye(5)[p.b]], axis=1)
    want = np.linalg.solve(x.T @ (x * p.h.to_numpy()[:, None]) + 2 * np.eye(9), -x.T @ p.g.to_numpy())
    for k in range(9):
        assert abs(got[("a", k) if k < 4 else ("b", k - 4)] - want[k]) < 1e-9


def test_chances_sum_to_the_rate(spark):
    rows = spark.range(300).select((F.col("id") % 50 + F.when(F.col("id") < 5, 900).otherwise(0)).cast("double").alias("g"))
    g = rows.toPandas().g.to_numpy()
    for rate in (0.05, 0.3, 0.9):
        t, sure = ensemble.sampling_threshold(rows, F.col("g"), rate).first()
        assert abs(np.minimum(1, g / t).sum() - rate * len(g)) < 1e-6 and sure == (g > t).sum()
    t, sure = ensemble.sampling_threshold(rows, F.col("g"), 1.0).first()
    assert (t, sure) == (1.0, (g > 0).sum())
    assert ensemble.sampling_threshold(rows.limit(0), F.col("g"), 0.5).count() == 0


def test_recalibration_finds_a_planted_slope_and_leaves_a_right_score_alone(spark):
    rows = spark.range(2000).select(F.lit(1.0).alias("w"), (F.col("id") % 40 / 20 - 1).alias("r")).withColumn("y", F.exp(0.1 + 1.5 * F.col("r")))
    b0, b1, gain = ensemble.slope_recalibration(rows, "y", F.col("r"), "w", ridge=1e-6)
    assert abs(b0 - 0.1) < 1e-4 and abs(b1 - 1.5) < 1e-4 and gain > 0
    assert ensemble.slope_recalibration(rows, "y", 0.1 + 1.5 * F.col("r"), "w") == (0.0, 1.0, 0.0)
    assert ensemble.slope_recalibration(rows.limit(0), "y", F.col("r"), "w") == (0.0, 1.0, 0.0)


def test_ranked_sequence_and_votes():
    one = {frozenset(k): v for k, v in {"a": 1.0, "b": 2.0, "c": 3.0, "ab": 5.0, "abc": 9.0, "bc": 4.0, "ac": 1.0}.items()}
    mains, path, sizes = select.ranked_sequence(one, 3)
    assert mains == [frozenset("a"), frozenset("b"), frozenset("c")]
    assert path == [frozenset("ab"), frozenset("bc"), frozenset("ac"), frozenset("abc")] and sizes == [0, 1, 2, 4]
    mains, path, _ = select.ranked_sequence({k: v for k, v in one.items() if len(k) < 3}, 3, prune_mains=True)
    assert mains == [] and path[:4] == [frozenset("a"), frozenset("b"), frozenset("ab"), frozenset("c")]
    votes = {frozenset(k): v for k, v in {"ab": (0.2, True, True), "bc": (-0.1, False, True), "ac": (-9.0, False, False), "abc": (1.0, True, True)}.items()}
    every = set(one)
    assert select.voted(votes, every, 32) == {frozenset(k) for k in ("a", "b", "c", "ab", "bc")}
    assert select.voted(votes, every, 3) == {frozenset(k) for k in ("a", "b", "c", "ab")}
    votes[frozenset("ac")] = (0.1, True, True)
    assert select.voted(votes, every, 32) == every


def test_rules_with_limits_off_and_undefined_measures(spark):
    rows = spark.createDataFrame([("train", None), ("test", 1.04), ("test", 0.9)], "role string, ae double")
    assert [r.status for r in rules.overall_ae(rows).collect()] == ["info", "pass", "warning"]
    off = {**rules.THRESHOLDS, "ae_test": None, "factor_z": None}
    assert [r.status for r in rules.overall_ae(rows, off).collect()] == ["info", "pass", "pass"]
    bands = spark.createDataFrame([(50.0, 1.2, 3.5), (45.0, 1.2, 2.5), (4.5, 0.8, -1.0), (0.5, 3.0, 9.0)], "mass double, ae double, z double")
    total = bands.agg(F.sum("mass").alias("mass"))
    assert [r.status for r in rules.factor_ae(bands, total).collect()] == ["warning", "info", "pass", "none"]
    assert [r.status for r in rules.factor_ae(bands, total, near=False).collect()] == ["warning", "pass", "pass", "none"]
    assert [r.status for r in rules.factor_ae(bands, total, limits=off).collect()] == ["warning", "warning", "warning", "none"]


def test_class_histogram_takes_exponents_before_rows_are_repeated(spark):
    rows = [(i % 3, float(i % 5), "ab"[i % 2], 1.0 + i % 4, (i % 7) / 3) for i in range(60)]
    df = spark.createDataFrame(rows, "leaf int, bin double, label string, w double, s double")
    p, q = X.softmax([F.col("s"), -F.col("s")])
    out = ensemble.class_histogram(df, F.col("leaf"), {0: F.col("bin"), 1: F.col("leaf")}, "label", {"a": p, "b": q}, "w")
    repeats = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate" in x]
    assert repeats and not any("EXP" in x.upper().replace("EXPLODE", "") for x in repeats)
    want = {}
    for leaf, b, label, w, s in rows:
        one = 1 / (1 + np.exp(-2 * s))
        for c, x in (("a", one), ("b", 1 - one)):
            for cell in ((c, leaf, 0, int(b)), (c, leaf, 1, leaf)):
                want[cell] = want.get(cell, 0) + np.array([w * (x - (label == c)), w * x * (1 - x), 1])
    got = {(r["class"], r["leaf"], r["axis"], r["bin"]): (r["g"], r["h"], r["n"]) for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_leaf_values_repeat_no_rows_for_axes_they_leave_out(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["leaf_values_softmax"](spark, entry.SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS b0#" in plan and not any(f"AS b{a}#" in plan for a in (1, 2))
