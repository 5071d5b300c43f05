"""Fitted models on disk: JSON for the model, Parquet for its tables, and SQL for other engines."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputValueError
from ..plans.boost import Model, Tables, table_frame

VERSION = 1


def save(spark: SparkSession, path: str, model: Model, tables: Tables) -> None:
    """Write to a new folder through Spark's own writers, so that any of its file systems will do; tables of levels go along."""
    for k, (name, known) in enumerate(model.levels.items()):
        if isinstance(known, str):
            spark.read.parquet(known).write.parquet(f"{path}/levels/{k}")
            model = replace(model, levels={**model.levels, name: f"{path}/levels/{k}"})
    spark.createDataFrame([(VERSION, model.to_json())], "version int, model string").coalesce(1).write.json(f"{path}/model")
    table_frame(spark, model, tables).write.parquet(f"{path}/cells")


def load(spark: SparkSession, path: str) -> tuple[Model, DataFrame]:
    """The model and its cells as a DataFrame."""
    row = spark.read.schema("version int, model string").json(f"{path}/model").first()
    if row["version"] > VERSION:
        raise InputValueError(f"the model was written by version {row['version']}; this reads up to {VERSION}")
    return Model.from_json(row["model"]), spark.read.parquet(f"{path}/cells")


def rating_export(cells: DataFrame) -> DataFrame:
    """table_id and document: cells, values and relativities of each table as JSON, in the order of the cells."""
    one = F.struct("cells", "value", F.exp("value").alias("relativity"))
    return cells.groupBy("table_id", "features").agg(F.sort_array(F.collect_list(one)).alias("rows")).select("table_id", F.to_json(F.struct("features", "rows")).alias("document"))


def sql_bin(column: str, borders: list[float]) -> str:
    """A CASE chain for the bin of a numeric column; NaN is missing, as null is."""
    arms = " ".join(f"WHEN CAST({column} AS FLOAT) <= CAST({b!r} AS FLOAT) THEN {k}" for k, b in enumerate(borders, 1))
    return f"CASE WHEN {column} IS NULL OR isnan(CAST({column} AS DOUBLE)) THEN 0 {arms} ELSE {len(borders) + 1} END"


def sql_score(model: Model, constant: float, tables: Tables) -> str:
    """A SQL expression of the raw score of numeric features."""
    if model.levels:
        raise InputValueError("export of categorical features needs their levels joined first")
    parts = [repr(float(model.f0 + constant))]
    for axes, t in tables.items():
        at = "0"
        for a, size in zip(axes, t.shape, strict=True):
            at = f"({at} * {size} + {sql_bin(model.features[a], model.borders[a])})"
        arms = " ".join(f"WHEN {k} THEN {float(v)!r}" for k, v in enumerate(t.ravel()))
        parts.append(f"CASE {at} {arms} END")
    return " + ".join(f"CAST({p} AS DOUBLE)" for p in parts)
