"""Deterministic hold-out split.

``randomSplit`` depends on row order inside partitions, so the same data
can split differently after a recomputation or a repartition.  Here a row's
side is a function of its key: the first 8 hex digits of
md5("q1:q2:seed") taken modulo 100, which is stable under any
partitioning, re-execution after executor loss, and reproducible in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(seed: int, keys=("q1", "q2")) -> Column:
    text = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(100))


def with_fold(df: DataFrame, folds: int = 3, seed: int = 42) -> DataFrame:
    """Adds ``fold``: like the split a function of the key, so it does not depend on the partitioning."""
    return df.withColumn("fold", F.pmod(bucket(seed + 1), F.lit(folds)).cast("int"))


def with_split(df: DataFrame, train_percent: int = 80, seed: int = 42) -> DataFrame:
    return df.withColumn("part", F.when(bucket(seed) < train_percent, "train").otherwise("test"))


def split(df: DataFrame, train_percent: int = 80, seed: int = 42):
    b = bucket(seed)
    return df.filter(b < train_percent), df.filter(b >= train_percent)
