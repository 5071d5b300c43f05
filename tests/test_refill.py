"""Bins left unused by heavy values."""

import numpy as np
import pytest

from ratewright.operators import binning


def slow(values, weights, borders, max_bin):
    """The greedy rule on sorted arrays."""
    v, w = np.array(values, np.float32), np.array(weights, float)
    parts = np.split(np.arange(len(v)), [int(np.searchsorted(v, np.float32(b), side="right")) for b in sorted(borders)])
    parts, out = [p for p in parts if len(p)], list(borders)
    while len(out) < max_bin - 1:
        mass = [w[p].sum() if len(p) > 1 else -1.0 for p in parts]
        if max(mass, default=-1) < 0:
            break
        k = int(np.argmax(mass))
        p = parts[k]
        cut = min(int(np.argmax(np.cumsum(w[p]) >= mass[k] / 2)), len(p) - 2)
        out.append(binning.separating_border(v[p[cut]], v[p[cut + 1]]))
        parts[k : k + 1] = [p[: cut + 1], p[cut + 1 :]]
    return sorted(out)


@pytest.mark.parametrize("seed, max_bin", [(1, 16), (2, 64), (3, 7), (4, 200)])
def test_refill_equals_the_greedy_rule(spark, seed, max_bin):
    rng = np.random.default_rng(seed)
    values = sorted({round(float(x), 2) for x in rng.exponential(3, 120)} | {0.0})
    weights = [1000.0 if v == 0 else float(rng.integers(1, 9)) for v in values]
    df = spark.createDataFrame([*zip(values, weights, strict=True), (None, 4.0), (float("nan"), 3.0)], "v double, w double")
    borders = sorted(r[0] for r in binning.quantile_borders(df, "v", "w", max_bin).collect())
    assert len(borders) < max_bin - 1
    got = binning.refill_borders(df, "v", "w", borders, max_bin)
    assert got == pytest.approx(slow(values, weights, borders, max_bin))
    assert len(got) == min(max_bin - 1, len(values) - 1) or max_bin - 1 >= len(values)


def test_refill_edges(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 1.0)], "v double, w double")
    assert binning.refill_borders(df, "v", "w", [], 16) == [1.5]
    assert binning.refill_borders(df, "v", "w", [1.5], 16) == [1.5]
    assert binning.refill_borders(df, "v", "w", [1.5], 2) == [1.5]
    assert binning.refill_borders(df.where("v > 5"), "v", "w", [], 16) == []
    assert binning.separating_border(1.0, np.nextafter(np.float32(1.0), np.float32(2))) == 1.0
