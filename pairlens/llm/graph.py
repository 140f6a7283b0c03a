"""Connected components of a link table, as DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import stored


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component) of every linked node; component = its smallest node.

    Alternates two star steps until nothing changes: every node's larger
    neighbours are linked to its smallest one, then its smaller ones are.  The
    number of rounds grows with the logarithm of the longest chain.  Per round
    only minima are aggregated, so a node with very many links is no one task's
    work.  Nulls and self links are ignored; no links give an empty result.
    """
    now = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .where(F.col("u") != F.col("v")).distinct(), "links")
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.toDF("u", "v")))
        now = stored(small.where("u != v").distinct(), "links")
    # Every node now points at its smallest one.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
