"""Review rules: each gives a status (pass, info, warning or critical) to the measures of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of the rules.  A limit of None turns its rule off.
THRESHOLDS: dict[str, float | None] = {
    "ae_train": 0.02,
    "ae_validation": 0.05,
    "ae_test": 0.05,
    "factor_ae": 0.10,
    "factor_min_mass": 0.01,
    "factor_z": 3.0,
    "decile_ae": 0.05,
    "near_miss_z": 2.0,
    "missing_effect": 0.05,
    "thin_cell_mass": 0.001,
    "psi_warn": 0.10,
    "psi_critical": 0.25,
    "train_gap": 0.05,
    "unseen_mass": 0.01,
}


def _beyond(value: Column, limit: float | None) -> Column:
    return F.lit(False) if limit is None else F.coalesce(value > limit, F.lit(False))


def overall_ae(datasets: DataFrame, limits: dict = THRESHOLDS) -> DataFrame:
    """``datasets`` (role: train, validation or test; ae) with status; info where nothing is expected."""
    off = F.coalesce(*[F.when(F.col("role") == r, _beyond(F.abs(F.col("ae") - 1), limits[f"ae_{r}"])) for r in ("train", "validation", "test")])
    return datasets.withColumn("status", F.when(F.col("ae").isNull(), "info").when(off, "warning").otherwise("pass"))


def _band_status(ae: Column, z: Column, limit: float | None, limits: dict, near: bool) -> Column:
    off = _beyond(F.abs(ae - 1), limit)
    certain = F.lit(True) if limits["factor_z"] is None else F.coalesce(F.abs(z) >= limits["factor_z"], F.lit(False))
    close = F.lit(False) if limits["near_miss_z"] is None or not near else F.coalesce(F.abs(z) >= limits["near_miss_z"], F.lit(False))
    return F.when(off & certain, "warning").when(off & close, "info").otherwise("pass")


def factor_ae(bands: DataFrame, total: DataFrame, near: bool = True, limits: dict = THRESHOLDS) -> DataFrame:
    """``bands`` (mass, ae, z) with status: info is a near miss, none a band with too little of ``total`` (mass, one row)."""
    whole = total.select(F.col("mass").alias("_mass"))
    enough = (F.col("_mass") > 0) & (F.col("mass") >= F.col("_mass") * (limits["factor_min_mass"] or 0.0))
    judged = F.when(enough, _band_status(F.col("ae"), F.col("z"), limits["factor_ae"], limits, near)).otherwise("none")
    return bands.join(F.broadcast(whole)).withColumn("status", judged).drop("_mass")


def decile_ae(bands: DataFrame, near: bool = True, limits: dict = THRESHOLDS) -> DataFrame:
    """``bands`` of predicted rate (ae, z) with status."""
    return bands.withColumn("status", _band_status(F.col("ae"), F.col("z"), limits["decile_ae"], limits, near))


def drift(values: DataFrame, limits: dict = THRESHOLDS) -> DataFrame:
    """``values`` (psi) with status."""
    return values.withColumn("status", F.when(_beyond(F.col("psi"), limits["psi_critical"]), "critical").when(_beyond(F.col("psi"), limits["psi_warn"]), "warning").otherwise("pass"))


def explained(train: DataFrame, later: DataFrame, limits: dict = THRESHOLDS) -> DataFrame:
    """rule, value, status of beats_null and train_gap; both sides hold explained (share of the deviance, one row)."""
    both = train.select(F.col("explained").alias("first")).join(F.broadcast(later.select(F.col("explained").alias("later"))))
    fall = F.col("first") - F.col("later")
    rules = [
        F.struct(F.lit("beats_null").alias("rule"), F.col("later").alias("value"), F.when(F.col("later") <= 0, "critical").otherwise("pass").alias("status")),
        F.struct(F.lit("train_gap").alias("rule"), fall.alias("value"), F.when(_beyond(fall, limits["train_gap"]), "warning").otherwise("pass").alias("status")),
    ]
    return both.select(F.explode(F.array(*rules)).alias("r")).select("r.*")


def unseen(values: DataFrame, total: DataFrame, limits: dict = THRESHOLDS) -> DataFrame:
    """feature, n_values, share, status of unseen values (feature, mass) against ``total`` (mass, one row)."""
    sums = values.groupBy("feature").agg(F.count("*").alias("n_values"), F.sum("mass").alias("mass"))
    share = F.try_divide("mass", "_mass")
    found = sums.join(F.broadcast(total.select(F.col("mass").alias("_mass")))).select("feature", "n_values", share.alias("share"))
    return found.withColumn("status", F.when(_beyond(F.col("share"), limits["unseen_mass"]), "warning").otherwise("info"))
