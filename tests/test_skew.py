"""Questions that very many pairs name: adaptive execution splits them, on either side."""
import pytest
from pyspark.sql import functions as F

from pairlens.operators.pairs import join_questions
from pairlens.sources.testdata import train_pairs

SPLIT = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
         "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
         "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
         "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k, None) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("hot,how", [("q1", "inner"), ("q2", "left")])
def test_hot_question_is_split(spark, small_splits, hot, how):
    other = "q2" if hot == "q1" else "q1"
    pairs = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 997).alias(hot),
        (F.col("id") % 1889 + 1000).alias(other), F.sha2(F.col("id").cast("string"), 256).alias("load"))
    qf = spark.range(0, 4000, 1, 4).select(F.col("id").alias("qid"), (F.col("id") * 2.0).alias("x"))
    joined = join_questions(pairs, qf, how)
    assert joined.count() == 60_000
    run = joined.select("q1", "q2", "a_x", "b_x", "load")
    rows = run.filter("a_x != 2 * q1 or b_x != 2 * q2")
    assert rows.count() == 0
    run.rdd.count()
    assert "skew=true" in run._jdf.queryExecution().executedPlan().toString()


def test_many_copies_of_one_text(spark):
    keys = spark.range(0, 5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(
        F.col("id").cast("string")).alias("key"), F.lit(4).alias("n_words"))
    got = train_pairs(keys)
    copies = got.filter("label = 1 and q1 = 0 and q2 % 3 = 0 and q2 > 0 and q2 != 1")
    assert copies.select("q2").distinct().count() == 1666
