"""Ranks and running sums over all rows in an order, without a window over all rows.

Rows are range-partitioned and sorted by their keys once; the same tasks sum them up as they pass, and the result is
written.  The sums of the partitions before each, a row for each partition and group, are added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import new_path, written

#: A side is broadcast only when a count has shown that it has no more rows than this.
BROADCAST_ROWS = 50_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows; at most one more is counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _summed(columns: list[str], sums: list[str], group: str | None):
    """A function over the sorted batches of a partition: its rows with their place and sums within partition and group."""

    def run(batches):
        part, last, started, place, carried = TaskContext.get().partitionId(), None, False, 0, [0] * len(sums)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = [0]
            if group:
                key = batch.column(group)
                # Runs of equal keys; nulls are equal to each other.
                codes = np.asarray(key.dictionary_encode(null_encoding="encode").indices)
                starts += (np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()
                if started and key[0].as_py() != last:
                    place, carried = 0, [0] * len(sums)
                last, started = key[n - 1].as_py(), True
            values = [pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False) for c in sums]
            ranks, totals = np.empty(n, np.int64), [np.empty(n, v.dtype) for v in values]
            for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                if k:
                    place, carried = 0, [0] * len(sums)
                ranks[a:b] = np.arange(place, place + b - a)
                place += b - a
                for i, v in enumerate(values):
                    totals[i][a:b] = np.cumsum(np.concatenate([np.array([carried[i]], v.dtype), v[a:b]]))[1:]  # in the order of the rows
                    carried[i] = totals[i][b - 1]
            extra = [pa.array(ranks), pa.array(np.full(n, part, np.int64)), *map(pa.array, totals)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *extra], names=[*columns, "rank", "_part", *[f"cum_{c}" for c in sums]])

    return run


def running(df: DataFrame, order: list[Column], sums: list[str], group: str | None = None) -> DataFrame:
    """``df`` with rank (0, 1, ...) and cum_<c> for each of ``sums``: sums up to and with the row, in the order given.

    Within each value of ``group``, if any.  Rows that tie in all keys are ranked in any order; null keys come first
    in an ascending order and last in a descending one; null values add nothing.
    """
    spark = df.sparkSession
    keys = [*([F.col(group).asc()] if group else []), *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    kinds = {c: T.LongType() if isinstance(df.schema[c].dataType, whole) else T.DoubleType() for c in sums}
    plain = df.withColumns({f"_s_{c}": F.col(c).cast(kinds[c]) for c in sums})
    sorted_rows = plain.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    schema = T.StructType([*plain.schema.fields, T.StructField("rank", T.LongType()), T.StructField("_part", T.LongType()), *[T.StructField(f"cum__s_{c}", kinds[c]) for c in sums]])
    rows = written(sorted_rows.mapInArrow(_summed(plain.columns, [f"_s_{c}" for c in sums], group), schema), new_path(spark, "ordered"))
    by = ["_part", *([group] if group else [])]
    ends = rows.groupBy(*by).agg((F.max("rank") + 1).alias("_n"), *[F.max_by(f"cum__s_{c}", "rank").alias(f"_e_{c}") for c in sums])
    before = Window.partitionBy(*by[1:]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    shift = ends.select(F.col("_part").alias("_p"), *([F.col(group).alias("_g")] if group else []), ahead("_n").alias("_n"), *[ahead(f"_e_{c}").alias(f"_e_{c}") for c in sums])
    met = F.col("_part") == F.col("_p")
    joined = rows.join(small_side(shift), met & F.col(group).eqNullSafe(F.col("_g")) if group else met)
    return joined.select(*df.columns, (F.col("rank") + F.col("_n")).alias("rank"), *[(F.col(f"cum__s_{c}") + F.col(f"_e_{c}")).alias(f"cum_{c}") for c in sums])
