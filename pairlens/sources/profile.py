"""Source profile: row count, distinct keys and list lengths in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(name: str, df: DataFrame, keys: list[str], list_col: str | None = None) -> DataFrame:
    """One row: source, n_rows, n_keys, min_len, max_len (NULL without a list column).

    ``n_keys`` below ``n_rows`` reports duplicate keys, which the operators
    resolve deterministically (a repeated pair keeps its smallest label).
    """
    size = F.size(list_col) if list_col else F.lit(None).cast("int")
    return df.agg(F.lit(name).alias("source"),
                  F.count(F.lit(1)).alias("n_rows"),
                  F.count_distinct(*[F.col(k) for k in keys]).alias("n_keys"),
                  F.min(size).cast("bigint").alias("min_len"),
                  F.max(size).cast("bigint").alias("max_len"))


def profiles(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
