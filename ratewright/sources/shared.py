"""Tables in the folder of ``spark.checkpoint.dir``, which driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import InputValueError

#: Used only where the session names no folder and runs in one process, as in tests.
LOCAL_DEFAULT = "file:///tmp/checkpoints/ratewright"


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise InputValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(named or LOCAL_DEFAULT).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read back, which cuts its lineage and fixes its rows."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
