from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlens.operators.ordering import with_dense_index, with_running_sum


def test_dense_index_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), (F.col("id") % 13).alias("v"))
    got = with_dense_index(df, [F.col("k").desc()], "i").select("k", "i")
    want = df.select("k", (F.row_number().over(Window.orderBy(F.col("k").desc())) - 1).alias("i"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_running_sum(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("k"), (F.col("id") % 5).alias("v"))
    got = {r.k: r.s for r in with_running_sum(df, [F.col("k")], F.col("v"), "s", partitions=7).collect()}
    acc, want = 0, {}
    for k in range(3000):
        acc += k % 5
        want[k] = acc
    assert got == want
