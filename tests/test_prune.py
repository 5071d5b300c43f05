"""Pruning of a fitted bank on the rows that its bags lack."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewright.errors import InputValueError
from ratewright.plans import boost, prune


@pytest.fixture(scope="module")
def rows(spark):
    t = spark.range(3000).select("id", *[(F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(20))).cast("double").alias(n) for k, n in enumerate("abc")], (1.0 + F.col("id") % 2).alias("w"))
    mu = F.exp(F.when(F.col("a") > 9, 0.8).otherwise(0.0) + F.when((F.col("a") > 9) & (F.col("b") > 9), 0.9).otherwise(0.0))
    return t.withColumn("y", F.round(mu * (0.5 + F.pmod(F.xxhash64(F.lit(9), F.col("id")), F.lit(1000)) / 1000), 6)).cache()


@pytest.fixture(scope="module")
def bags(rows):
    return boost.fit_bags(rows, ["a", "b", "c"], "y", boost.Settings(rounds=9, rate=0.4, depth=2, max_bin=6, patience=9, seed=2), weight="w", bags=3, share=0.6)


def test_deviances_equal_those_by_hand(rows, bags):
    mean, models = bags
    got = prune.prune(rows, mean, models, "y", "w", share=0.6)
    measure = boost.axis_weights(rows, mean, "w")
    binned, names = mean.binned(rows)
    pdf = binned.select(*names, "y", "w", *[boost.in_bag("id", b, 0.6, 2).alias(f"in{b}") for b in range(3)]).toPandas()
    bins, y, w = [pdf[n].to_numpy() for n in names], pdf["y"].to_numpy(), pdf["w"].to_numpy()
    jury = sum((~pdf[f"in{b}"]).astype(int) for b in range(3)).to_numpy()
    own = [boost.purify(boost.to_tables(m), measure) for m in models]
    for size, deviance in zip(got.sizes, got.deviances, strict=True):
        raw = np.zeros(len(y))
        for b, (m, (c, tables)) in enumerate(zip(models, own, strict=True)):
            score = m.f0 + c + sum(t[tuple(bins[a] for a in u)] for u, t in tables.items() if len(u) == 1 or u in got.path[:size])
            raw += np.where(pdf[f"in{b}"], 0.0, score)
        mu = np.exp(raw[jury > 0] / jury[jury > 0])
        y1, w1 = y[jury > 0], w[jury > 0]
        assert deviance == pytest.approx((w1 * 2 * (y1 * np.log(y1 / mu) - (y1 - mu))).sum() / w1.sum())
    assert got.path and got.sizes[-1] == len(got.path)


def test_the_planted_pair_stays_and_noise_goes(rows, bags):
    mean, models = bags
    by_path = prune.prune(rows, mean, models, "y", "w", share=0.6, fraction=0.9, tolerance=0.05)
    assert {(0, 1), (0,), (1,)} <= set(by_path.tables) and len(by_path.deviances) == len(by_path.sizes)
    assert len(by_path.tables) <= len(prune.prune(rows, mean, models, "y", "w", share=0.6, fraction=1.0).tables)
    voted = prune.prune(rows, mean, models, "y", "w", share=0.6, how="vote", least_gain=1e-3)
    assert (0, 1) in voted.tables and voted.votes[0, 1][0] > 0.01 and voted.votes[0, 1][1]
    for u, (gain, first, _) in voted.votes.items():
        assert gain > 0.001 or not first, u
    full = boost.purify(boost.to_tables(mean), boost.axis_weights(rows, mean, "w"))[1]
    assert all(np.array_equal(full[u], t) for u, t in voted.tables.items())


def test_prune_edges(rows, bags):
    mean, models = bags
    with pytest.raises(InputValueError):
        prune.prune(rows, mean, models, "y", how="guess")
    held = prune.prune(rows, mean, models, "y", share=1.0)  # no row is out of any bag
    assert held.deviances == [] and set(held.tables) == set(boost.purify(boost.to_tables(mean), boost.axis_weights(rows, mean))[1])
