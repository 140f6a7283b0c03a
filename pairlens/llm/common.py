"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts lineage so that every later branch, retry or replacement executor
    reads the same rows from shared storage.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def partitions_for(rows: int, rows_per_partition: int, at_least: int = 1) -> int:
    """How many partitions ``rows`` rows need: grows with the input, no upper end."""
    return max(at_least, -(-rows // rows_per_partition))


#: Rows and bytes up to which a measured side is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 32_000_000


def small_side(df: DataFrame, size: Column | None = None) -> DataFrame:
    """``df``, marked for broadcast if measuring it (it should be stored) shows few rows and bytes.

    ``size`` gives the bytes of a row's strings and lists; rows of a few numbers
    need none.  Beyond the bounds the planner joins by shuffle; the result is the same.
    """
    rows, held = df.agg(F.count(F.lit(1)), F.sum(size if size is not None else F.lit(0)).cast("long")).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (held or 0) <= BROADCAST_BYTES else df
