"""Question features and pairs laid out by the join key, so that pair joins do not shuffle features again.

Both sides of a pair join to the same features.  Written bucketed on ``qid`` with
the session's partition count, they are read in place by both joins; pairs written
bucketed on ``q1`` are deduplicated and joined to their first question in place too,
so that of five shuffles only the one on ``q2`` is left.

A bucket is one task, and adaptive execution cannot split it.  Where one question
is named by very many pairs, the same files are therefore read plainly: both sides
are shuffled and the partitions of the hot question are split.  Which way to go is
measured once per pair table (``hot_questions``).
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.session import SCRATCH_CODEC, reliable_checkpoint, scratch_path

#: A question is hot if it is in more pairs than this and than this many times a partition's share.
HOT_PAIRS, HOT_TIMES = 10_000, 2


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def can_bucket(spark: SparkSession) -> bool:
    """Whether tables can be registered without touching a metastore or the working directory.

    The files go to the shared folder; only the in-memory catalog knows the table,
    and only if the session names its warehouse folder (which the catalog creates).
    """
    warehouse = spark.conf.get("spark.sql.warehouse.dir", "").removeprefix("file:").rstrip("/")
    default_warehouse = os.path.join(os.getcwd(), "spark-warehouse")
    return (spark.conf.get("spark.sql.catalogImplementation", "in-memory") == "in-memory" and bool(warehouse)
            and os.path.abspath(warehouse) != default_warehouse)


@dataclass(frozen=True)
class Laid:
    """A table written once: its files, and its name in the catalog if they are bucketed."""

    path: str
    table: str | None

    def in_place(self, spark: SparkSession) -> DataFrame:
        """Read with its buckets, where there are any."""
        return spark.table(self.table) if self.table else spark.read.parquet(self.path)

    def plain(self, spark: SparkSession) -> DataFrame:
        """The same files without their buckets: joins shuffle and can split hot keys."""
        return spark.read.parquet(self.path)


def lay_out(df: DataFrame, key: str, name: str, path: str | None = None, in_groups: bool = False) -> Laid:
    """Write ``df`` bucketed and sorted on ``key`` into the shared folder (plainly where tables cannot be registered).

    ``in_groups``: its tasks hold whole groups of keys (``vectors.group_of``), each of which falls into one bucket,
    so the rows are not shuffled again: a task writes a file for each bucket that its groups fall into.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    if not can_bucket(spark):
        df.write.option("compression", SCRATCH_CODEC).parquet(path)
        return Laid(path, None)
    n = shuffle_partitions(spark)
    table = f"pairlens_{name}_{uuid.uuid4().hex[:12]}"
    (df if in_groups else df.repartition(n, key)).write.bucketBy(n, key).sortBy(key).options(path=path, compression=SCRATCH_CODEC).saveAsTable(table)
    return Laid(path, table)


def hot_questions(pairs: DataFrame) -> bool:
    """Whether some question is in so many pairs that its bucket would outweigh the others.

    Counted per side with partial sums; one row comes back.
    """
    n = shuffle_partitions(pairs.sparkSession)
    sides = pairs.select(F.lit(1).alias("side"), F.col("q1").alias("q")).union(pairs.select(F.lit(2), "q2"))
    most, total = sides.groupBy("side", "q").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n") / 2).first()
    return (most or 0) > max(HOT_PAIRS, HOT_TIMES * (total or 0) / n)


def features_for(features: DataFrame, hot: bool, in_groups: bool = False) -> DataFrame:
    """Features written once for both pair joins: in place, or to be shuffled if a question is hot (``in_groups``: see ``lay_out``)."""
    spark = features.sparkSession
    if not can_bucket(spark):
        return reliable_checkpoint(features)
    laid = lay_out(features, "qid", "features", in_groups=in_groups)
    return laid.plain(spark) if hot else laid.in_place(spark)
