"""Question features kept up to date: only the buckets of new, changed and removed questions are rewritten.

The features lie in a folder partitioned by a hash bucket of the question id, each
with the content hash of its word list.  An update compares hashes, computes the
features of changed questions alone and swaps the buckets they fall into (dynamic
partition overwrite); all other files stay as they are.  A removed question leaves
a row without content, so a bucket is never left with stale rows.  If the word
vectors, the settings or the columns are others than before, everything is computed
anew, since every sum may change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.operators.vectors import question_features, vector_facts
from pairlens.session import reliable_checkpoint

BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def content_hash(words: str = "word_ids"):
    return F.sha2(F.array_join(F.transform(words, lambda w: w.cast("string")), ",", "-"), 256)


def fingerprint(word_vec: DataFrame, **settings) -> str:
    """What the features depend on besides the questions, in any order of rows."""
    facts = vector_facts(word_vec)
    total = word_vec.agg(F.sum(F.xxhash64("wid", "features").cast("decimal(38,0)"))).first()[0]
    return f"{facts} {total} {sorted(settings.items())}"


def _listed(question: DataFrame, buckets: int) -> DataFrame:
    """(qid, word_ids, content, bucket); a repeated id keeps its smallest word list."""
    return question.groupBy("qid").agg(F.min("word_ids").alias("word_ids")).withColumns({
        "content": content_hash(), "bucket": F.pmod(F.xxhash64("qid"), F.lit(buckets)).cast("int")})


def _write(features: DataFrame, path: str) -> None:
    (features.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(f"{path}/features"))


def update_features(question: DataFrame, word_vec: DataFrame, path: str, buckets: int = BUCKETS, missing: str = "zero",
                    columns: list[str] | None = None) -> dict[str, int]:
    """Bring the features under ``path`` up to date with ``question``.

    -> how many questions were computed and removed, and how many buckets were written.
    """
    spark = question.sparkSession
    wanted = fingerprint(word_vec, buckets=buckets, missing=missing, columns=columns)
    known = spark.read.text(f"{path}/fingerprint").first()[0] if _exists(spark, f"{path}/fingerprint") else None
    now = reliable_checkpoint(_listed(question, buckets))

    def computed(rows: DataFrame) -> DataFrame:
        own = question_features(rows, word_vec, missing=missing, columns=columns)
        return rows.select("qid", "content", "bucket").join(own, "qid")

    if known != wanted:
        whole = reliable_checkpoint(computed(now))
        (whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/features"))
        spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/fingerprint")
        return {"computed": whole.count(), "removed": 0, "buckets": whole.select("bucket").distinct().count()}

    before = spark.read.parquet(f"{path}/features")
    old = before.select("qid", F.col("content").alias("_old"), F.col("bucket").alias("_bucket"))
    both = reliable_checkpoint(now.select("qid", "content", "bucket").join(old, "qid", "full").where(
        ~F.col("content").eqNullSafe(F.col("_old"))).select("qid", "content", F.coalesce("bucket", "_bucket").alias("bucket")))
    changed, removed = both.where("content is not null"), both.where("content is null")
    touched = reliable_checkpoint(both.select("bucket").distinct())
    n_touched = touched.count()
    if n_touched:
        fresh = computed(now.join(changed.select("qid"), "qid", "left_semi"))
        # At most ``buckets`` small rows: a broadcast of bounded size.
        kept = before.join(F.broadcast(touched), "bucket", "left_semi").join(both.select("qid"), "qid", "left_anti")
        _write(reliable_checkpoint(kept.unionByName(fresh, allowMissingColumns=True).unionByName(
            removed.select("qid", "content", "bucket"), allowMissingColumns=True).select(*before.columns)), path)
    return {"computed": changed.count(), "removed": removed.count(), "buckets": n_touched}


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The features of all present questions."""
    return spark.read.parquet(f"{path}/features").where("content is not null").drop("content", "bucket")
