"""The demonstration book of rows: sales lines with parts, planted targets, weights and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..errors import InputTypeError, InputValueError

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

#: Columns of the book over the driver's tables; the same text runs on other SQL engines.
BOOK_SELECT = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus,
       p_brand, p_type, p_size,
       l_extendedprice AS price,
       CAST(0.25 AS DOUBLE) + CAST(l_linenumber AS DOUBLE) / 8 AS exposure,
       CAST(1 + l_suppkey % 3 AS DOUBLE) AS weight,
       CAST((l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 4 AS DOUBLE) AS claims,
       CAST(0.5 AS DOUBLE) + CAST((l_partkey * 13 + l_suppkey * 5) % 100 AS DOUBLE) / 80 AS mu,
       CAST((l_partkey * 13 + l_suppkey * 5 + l_orderkey) % 100 AS DOUBLE) / 50 - 1 AS score,
       CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE) AS returned,
       CASE WHEN (l_orderkey + l_partkey) % 17 = 0 THEN NULL ELSE p_brand END AS brand,
       CAST((l_orderkey * 7 + l_partkey) % 5 AS INT) AS fold
FROM lineitem JOIN part ON l_partkey = p_partkey
"""


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def book(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(
        BOOK_SELECT.replace("FROM lineitem JOIN part", "FROM {lineitem} JOIN {part}"),
        lineitem=read_table(spark, folder, "lineitem"),
        part=read_table(spark, folder, "part"),
    )


def select_features(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, in that order; extra ones are ignored, missing ones are an error."""
    if lost := [n for n in names if n not in df.columns]:
        raise InputValueError(f"missing columns: {', '.join(lost)}")
    return df.select(*names)


def categorical_features(df: DataFrame, names: list[str]) -> list[str]:
    """Those of ``names`` that are strings; other types must be numeric or boolean."""
    kinds = dict(df.dtypes)
    for n in names:
        if kinds[n].startswith(("array", "map", "struct", "timestamp", "date", "interval", "binary", "variant")):
            raise InputTypeError(f"column {n} is {kinds[n]}; cast it to a number or a string")
    return [n for n in names if kinds[n] == "string"]


def validate(df: DataFrame, y: str, weight: str | None = None, exposure: str | None = None, positive: bool = False) -> None:
    """One pass that counts bad rows of target, weight and exposure, and raises if there are any."""
    bad = {f"target {y} is missing": f"{y} IS NULL OR isnan({y})"}
    if positive:
        bad[f"target {y} is not positive"] = f"{y} <= 0"
    if weight:
        bad[f"weight {weight} is missing or negative"] = f"{weight} IS NULL OR isnan({weight}) OR {weight} < 0"
    if exposure:
        bad[f"exposure {exposure} is not positive"] = f"{exposure} IS NULL OR isnan({exposure}) OR {exposure} <= 0"
    counts = df.selectExpr(*[f"count_if({x}) AS c{k}" for k, x in enumerate(bad.values())]).first()
    if found := [f"{what} in {n} rows" for what, n in zip(bad, counts, strict=True) if n]:
        raise InputValueError("; ".join(found))
