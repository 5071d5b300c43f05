"""Scoring of a stream of rows with a fitted model, and windowed actual-against-expected with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.boost import Model


def score_stream(rows: DataFrame, model: Model) -> DataFrame:
    """A streaming (or static) DataFrame with raw and prediction; scoring keeps no state."""
    return model.score(rows)


def monitor(scored: DataFrame, time: str, y: str, width: str, late: str) -> DataFrame:
    """Actual, expected and their ratio for each time window; rows later than ``late`` are dropped by the watermark."""
    windows = scored.withWatermark(time, late).groupBy(F.window(time, width).alias("window"))
    sums = windows.agg(F.count("*").alias("n"), F.sum(y).alias("actual"), F.sum("prediction").alias("expected"))
    return sums.withColumn("ae", F.try_divide("actual", "expected"))
