"""Gapless ranks within groups of any size, without a window over a whole group.

Rows are range-partitioned and sorted by (group, order), written once, and numbered by their place
in the written file.  Only one row for each file and group is aggregated, so that a group with a
third of all rows is spread over as many tasks as its rows need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import new_path, small_side


def ranked(df: DataFrame, group: str, order: list[str], rank: str) -> DataFrame:
    """``df`` with ``rank``: 0, 1, 2, ... within each ``group``, in the order of ``order``.

    Rows equal in group and order are numbered in any order, and may lie in different partitions.
    """
    spark = df.sparkSession
    path = new_path(spark, "ranked")
    tie = F.rand(7)  # deals out equal rows; the written table fixes the outcome
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_tie", tie)
    keys = [group, *order, "_tie"]
    keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie").write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    starts = rows.groupBy("_file", group).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    # Part numbers order the files; each file holds one range partition.
    shift = starts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    shift = shift.select(F.col("_file").alias("_f"), F.col(group).alias("_g"), "_shift")
    # One row for each file, and one more for each group that begins inside a file.
    joined = rows.join(small_side(shift), (F.col("_file") == F.col("_f")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn(rank, F.col("_row") + F.col("_shift")).select(*df.columns, rank)
