"""Tables written to the folder that driver and executors share.

Everything that cuts lineage goes through :func:`materialize`: a Parquet table under the folder
named by ``spark.checkpoint.dir``.  A lost executor costs nothing that has been written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and runs in one process, as in tests.
LOCAL_DEFAULT = "file:///tmp/checkpoints/ratewright"

#: A side is broadcast only when a count has shown that it has no more rows than this.
BROADCAST_ROWS = 50_000
#: The same for rows of one or two numbers or digests: 30 to 90 MB in memory.
BROADCAST_NARROW = 1_000_000

#: Spark's setting that shuffle files go at the end of the query that wrote them, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in a local session without one, a default."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_DEFAULT


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`new_path` named, through Hadoop's file systems."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a DataFrame that reads it."""
    return _written(df, new_path(df.sparkSession, name))


class Scratch:
    """Tables of one piece of work, below one folder of the shared folder.

    :meth:`clear` deletes them; what is to outlive it goes through :func:`materialize`.  An exception clears too.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.tables = spark, new_path(spark, name), 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as a table; the shuffle files that this took are deleted at once."""
        self.tables += 1
        was = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            return _written(df, f"{self.path}/{self.tables}-{name}")
        finally:
            self.spark.conf.set(CLEANUP, was)

    def clear(self) -> None:
        delete(self.spark, self.path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a materialized table of narrow rows), marked for broadcast if it is short enough.

    At most ``rows + 1`` rows are counted.  A longer table is returned as it is, so that the join
    shuffles and adaptive execution may split its skewed partitions.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
