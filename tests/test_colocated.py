"""Pair joins that read features and pairs in place, and the way back for hot questions."""
import re

import pytest
from pyspark.sql import functions as F

from pairlens.operators import colocated as L
from pairlens.operators.pairs import dedupe_pairs, join_questions

OFF = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]


@pytest.fixture
def no_broadcast(spark):
    for k in OFF:
        spark.conf.set(k, "-1")
    yield
    for k in OFF:
        spark.conf.unset(k)


def exchanges(df):
    """Keys of the plan's shuffles."""
    return [m.split("#")[0] for m in re.findall(r"Exchange hashpartitioning\(([^,]+)", df._jdf.queryExecution().executedPlan().toString())]


def tables(spark):
    pairs = spark.range(4000).select((F.col("id") % 97).alias("q1"), (F.col("id") % 89).alias("q2"), (F.col("id") % 2).cast("int").alias("label"))
    features = spark.range(100).select(F.col("id").alias("qid"), (F.col("id") * 2.0).alias("x"))
    return pairs, features


def test_features_are_not_shuffled_again(spark, no_broadcast):
    assert L.can_bucket(spark)
    pairs, features = tables(spark)
    before = join_questions(dedupe_pairs(L.lay_out(pairs, "q1", "pairs").plain(spark)), L.features_for(features, hot=True))
    after = join_questions(dedupe_pairs(L.lay_out(pairs, "q1", "pairs").in_place(spark)), L.features_for(features, hot=False))
    assert sorted(exchanges(before)) == ["q1", "q1", "q1", "q2", "q2"]
    assert exchanges(after) == ["q2"]  # the pairs, once
    rows = [sorted(map(tuple, df.select("q1", "q2", "label", "a_x", "b_x").collect())) for df in (before, after)]
    assert rows[0] == rows[1] and len(rows[0]) == 4000


def test_hot_questions_are_measured(spark):
    pairs, _ = tables(spark)
    assert not L.hot_questions(pairs) and not L.hot_questions(pairs.limit(0))
    many = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("q2"), F.col("id").alias("q1"))
    assert L.hot_questions(many)
    even = spark.range(60_000).select((F.col("id") % 1000).alias("q1"), (F.col("id") % 1009).alias("q2"))
    assert not L.hot_questions(even)


def test_plain_files_where_no_table_can_be_named(spark, monkeypatch):
    monkeypatch.setattr(L, "can_bucket", lambda spark: False)
    pairs, features = tables(spark)
    laid = L.lay_out(pairs, "q1", "pairs")
    assert laid.table is None and laid.in_place(spark).count() == 4000
    assert L.features_for(features, hot=False).count() == 100
