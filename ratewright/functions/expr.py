"""Column expressions shared by the operators; all stay inside whole-stage code generation (bins are a tree of CASEs)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Linear predictors are clamped to this range before exp.
CLAMP = 30.0


def missing(v: Column) -> Column:
    return v.isNull() | F.isnan(v)


def bin_index(v: Column, borders: Sequence[float]) -> Column:
    """0 for a missing value, else 1 + the number of borders below it: bins are closed on the right.

    Values and borders are compared as floats; infinities fall into the end bins.  A tree of CASEs halves the borders.
    """
    value = v.cast("float")

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low + 1)
        mid = (low + high) // 2
        return F.when(value <= F.lit(float(borders[mid])).cast("float"), among(low, mid)).otherwise(among(mid + 1, high))

    return F.when(missing(value), F.lit(0)).otherwise(among(0, len(borders)))


def low_bit(bin_: Column, at_most: int, missing_low: bool) -> Column:
    """Whether a bin goes to the low side of a split."""
    return F.when(bin_ == 0, F.lit(missing_low)).otherwise(bin_ <= at_most)


def leaf_index(splits: Sequence[tuple[Column, int, bool]]) -> Column:
    """The leaf of an oblivious tree: bit l is set on the low side of split l."""
    return sum((F.when(low_bit(b, k, m), F.lit(1 << l)).otherwise(F.lit(0)) for l, (b, k, m) in enumerate(splits)), F.lit(0))


def clamped(raw: Column) -> Column:
    return F.greatest(F.lit(-CLAMP), F.least(F.lit(CLAMP), raw))


def inverse_link(link: str, raw: Column) -> Column:
    """identity, log or logit: from linear predictor to mean."""
    if link == "identity":
        return raw
    if link == "log":
        return F.exp(clamped(raw))
    if link == "logit":
        e = F.exp(-F.abs(clamped(raw)))
        return F.when(raw >= 0, 1 / (1 + e)).otherwise(e / (1 + e))
    raise ValueError(f"unknown link {link}")


def softmax(raws: Sequence[Column]) -> list[Column]:
    """Class probabilities; each score is at most CLAMP below the largest."""
    top = F.greatest(*raws) if len(raws) > 1 else raws[0]
    parts = [F.exp(F.greatest(r - top, F.lit(-CLAMP))) for r in raws]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def _xlogx(y: Column, mu: Column) -> Column:
    return F.when(y > 0, y * F.ln(y / mu)).otherwise(F.lit(0.0))


def unit_deviance(loss: str, y: Column, mu: Column, power: float = 1.5) -> Column:
    """Twice the log-likelihood gap of one row to the saturated model."""
    if loss == "squared_error":
        return (y - mu) * (y - mu)
    if loss == "poisson":
        return 2 * (_xlogx(y, mu) - (y - mu))
    if loss == "gamma":
        return 2 * (-F.ln(y / mu) + (y - mu) / mu)
    if loss == "tweedie":
        p = power
        return 2 * (F.pow(F.greatest(y, F.lit(0.0)), F.lit(2 - p)) / ((1 - p) * (2 - p)) - y * F.pow(mu, F.lit(1 - p)) / (1 - p) + F.pow(mu, F.lit(2 - p)) / (2 - p))
    if loss == "binomial":
        return 2 * (_xlogx(y, mu) + _xlogx(1 - y, 1 - mu))
    raise ValueError(f"unknown loss {loss}")


def grad_hess(loss: str, y: Column, raw: Column, power: float = 1.5) -> tuple[Column, Column]:
    """First and second derivative of a row's loss by its linear predictor."""
    if loss == "squared_error":
        return raw - y, F.lit(1.0)
    if loss == "logistic":
        p = inverse_link("logit", raw)
        return p - y, F.greatest(p * (1 - p), F.lit(1e-12))
    mu = F.exp(clamped(raw))
    if loss == "poisson":
        return mu - y, mu
    if loss == "gamma":
        return 1 - y / mu, y / mu
    if loss == "tweedie":
        a, b = F.exp((1 - power) * clamped(raw)), F.exp((2 - power) * clamped(raw))
        return b - y * a, (2 - power) * b - (1 - power) * y * a
    raise ValueError(f"unknown loss {loss}")


LINKS = {"squared_error": "identity", "logistic": "logit", "poisson": "log", "gamma": "log", "tweedie": "log"}


def initial_score(loss: str, mean: Column) -> Column:
    """The constant linear predictor whose mean is the weighted mean of the target."""
    if loss == "squared_error":
        return mean
    if loss == "logistic":
        return F.ln(mean / (1 - mean))
    return F.ln(mean)


def variance_function(loss: str, mu: Column, power: float = 1.5) -> Column:
    return {"squared_error": F.lit(1.0), "poisson": mu, "gamma": mu * mu, "tweedie": F.pow(mu, F.lit(power)), "binomial": mu * (1 - mu)}[loss]


def soft_threshold(g: Column, l1: float) -> Column:
    """``g`` moved ``l1`` towards 0, and not past it."""
    return F.signum(g) * F.greatest(F.abs(g) - l1, F.lit(0.0)) if l1 > 0 else g


def newton_step(g: Column, h: Column, l2: float, l1: float = 0.0, most: float | None = None) -> Column:
    """-soft(g) / (h + l2), within ``most`` either way; 0 without curvature."""
    step = F.when(h + l2 > 0, -soft_threshold(g, l1) / (h + l2)).otherwise(0.0)
    return F.greatest(F.lit(-most), F.least(F.lit(most), step)) if most is not None else step


def newton_gain(g: Column, h: Column, l2: float, l1: float = 0.0, most: float | None = None) -> Column:
    """Twice the fall of the penalised quadratic loss by the step taken; soft(g)^2 / (h + l2) for a free step."""
    w = newton_step(g, h, l2, l1, most)
    return F.greatest(F.lit(0.0), -2 * soft_threshold(g, l1) * w - (h + l2) * w * w)
