"""Distributed running totals and dense row indexes.

A running total over a global order is usually written as an unpartitioned
window, which moves every row into one task.  Here the rows are
range-partitioned on the order key instead; each range partition is summed
on its own and shifted by the totals of the partitions before it.  The
per-partition totals are a table with one row per partition, so broadcasting
it is bounded by the partition count, not by the data.

The ranged rows are checkpointed into the shared checkpoint folder before
they are used twice: range boundaries come from sampling, and a
recomputation could draw different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.session import reliable_checkpoint

_PART = "_range_part"
_OFFSET = "_range_offset"


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_running_sum(df: DataFrame, order: list[Column], value: Column, out: str,
                     partitions: int | None = None, inclusive: bool = True) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all rows up to this one in ``order``.

    ``order`` must be a total order (ties broken by the caller); with
    ``inclusive=False`` the current row is excluded.
    """
    n = _partitions(df, partitions)
    ranged = (df.withColumn("_rs_value", value)
                .repartitionByRange(n, *order)
                .withColumn(_PART, F.spark_partition_id()))
    ranged = reliable_checkpoint(ranged)
    totals = ranged.groupBy(_PART).agg(F.sum("_rs_value").alias("_t"))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(_PART, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias(_OFFSET))
    upto = Window.partitionBy(_PART).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    running = F.coalesce(F.sum("_rs_value").over(upto), F.lit(0))
    return (ranged.join(F.broadcast(offsets), _PART)
                  .withColumn(out, F.col(_OFFSET) + running)
                  .drop(_PART, _OFFSET, "_rs_value"))


def with_dense_index(df: DataFrame, order: list[Column], out: str,
                     partitions: int | None = None) -> DataFrame:
    """Add a 0-based contiguous row index in ``order`` (a total order)."""
    return with_running_sum(df, order, F.lit(1).cast("long"), out,
                            partitions=partitions, inclusive=False)
