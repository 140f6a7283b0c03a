"""Connected components of the question graph, and splits that keep a component on one side.

Pairs of the same question (or of copies of it) on both sides of a split let a
model score what it was fitted on.  ``components`` labels every question with the
smallest question id that chains of pairs reach; ``with_component_split`` and
``with_component_fold`` then deal out components instead of pairs.

Where chains join nearly everything into one component, dealing out whole
components cannot give two sides of a wanted size.  ``linked_by='positive'``
follows only pairs labelled 1 (questions that say the same); pairs whose two
questions then fall on different sides belong to neither side and are marked
``between``, so no question is ever on both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.operators.split import bucket
from pairlens.session import reliable_checkpoint


def components(pairs: DataFrame) -> DataFrame:
    """(q1, q2) pairs -> (qid, component) of every question named in them.

    Every question points at the smallest one it knows of.  A round moves the
    pointers of the ends of every pair to the smaller of both and then follows
    each pointer one step further, so chains shorten by half and the number of
    rounds grows with the logarithm of the longest chain.  A round aggregates
    minima only: a question in very many pairs is combined before the shuffle.
    """
    edges = reliable_checkpoint(pairs.where("q1 is not null and q2 is not null and q1 != q2").select(
        F.least("q1", "q2").alias("u"), F.greatest("q1", "q2").alias("v")).distinct())
    named = pairs.select(F.col("q1").alias("qid")).union(pairs.select("q2")).where("qid is not null").distinct()
    now = reliable_checkpoint(named.select("qid", F.col("qid").alias("component")))
    while not edges.isEmpty():
        # The pointers of both ends, and of what they point at, go to the smallest of them.
        ends = (edges.join(now.toDF("u", "cu"), "u").join(now.toDF("v", "cv"), "v")
                .select("cu", "cv", F.least("cu", "cv").alias("low")).where("cu != cv"))
        hooks = ends.select(F.greatest("cu", "cv").alias("component"), "low").groupBy("component").agg(F.min("low").alias("low"))
        hooks = reliable_checkpoint(hooks)
        if hooks.isEmpty():
            break
        now = now.join(hooks, "component", "left").select("qid", F.coalesce("low", "component").alias("component"))
        now = reliable_checkpoint(_followed(reliable_checkpoint(now)))
        # Pairs inside one component have nothing more to tell.
        edges = reliable_checkpoint(
            edges.join(now.toDF("u", "cu"), "u").join(now.toDF("v", "cv"), "v").where("cu != cv")
            .select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct())
    return now


def _followed(now: DataFrame) -> DataFrame:
    """Pointers followed until they end at a question that points at itself."""
    while True:
        ahead = now.select(F.col("qid").alias("component"), F.col("component").alias("next"))
        moved = reliable_checkpoint(now.join(ahead, "component", "left").select(
            "qid", F.coalesce("next", "component").alias("component"), (F.col("next") != F.col("component")).alias("moved")))
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now


def _labelled(pairs: DataFrame, linked_by: str) -> DataFrame:
    """``pairs`` with the components ``c1`` and ``c2`` of their questions."""
    if linked_by not in ("all", "positive"):
        raise ValueError("linked_by must be 'all' or 'positive'")
    by = components(pairs if linked_by == "all" else pairs.where("label = 1"))
    joined = pairs.join(by.toDF("q1", "c1"), "q1", "left").join(by.toDF("q2", "c2"), "q2", "left")
    return joined.withColumns({"c1": F.coalesce("c1", "q1"), "c2": F.coalesce("c2", "q2")})


def _sides(pairs: DataFrame, linked_by: str, side, apart: Column, out: str) -> DataFrame:
    told = _labelled(pairs, linked_by).withColumns({"_s1": side("c1"), "_s2": side("c2")})
    value = F.when(F.col("_s1") == F.col("_s2"), F.col("_s1")).otherwise(apart)
    return told.withColumns({"component": F.least("c1", "c2"), out: value}).select(*pairs.columns, "component", out)


def with_component_split(pairs: DataFrame, train_percent: int = 80, seed: int = 42, linked_by: str = "all") -> DataFrame:
    """Adds ``component`` and ``part``: 'train' or 'test', or 'between' for a pair whose questions fall on both."""
    return _sides(pairs, linked_by, lambda c: F.when(bucket(seed, (c,)) < train_percent, "train").otherwise("test"),
                  F.lit("between"), "part")


def with_component_fold(pairs: DataFrame, folds: int = 3, seed: int = 42, linked_by: str = "all") -> DataFrame:
    """Adds ``component`` and ``fold``; -1 for a pair between two folds."""
    return _sides(pairs, linked_by, lambda c: F.pmod(bucket(seed + 1, (c,)), F.lit(folds)).cast("int"), F.lit(-1), "fold")
