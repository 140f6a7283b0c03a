"""Mergeable sketches of a source, kept per file.

A profile that counts distinct keys and sorts list lengths reads and shuffles the
whole source again whenever a file is added.  Here every file has one row of
sketches: its row count, a HyperLogLog sketch of its keys and a KLL sketch of its
list lengths (Spark's own sketch functions).  Sketches of files that are already
described are read, not computed, and sketches of all files are merged for the
profile, which holds for any set of files.

Bounds: the key count is within ``KEY_BOUND`` of the exact one (three standard
errors of 2^14 registers), the rank of a quantile within ``RANK_BOUND``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.session import reliable_checkpoint

LOG_REGISTERS, KLL_SIZE = 14, 400
KEY_BOUND, RANK_BOUND = 0.025, 0.0133
QUANTILES = (0.5, 0.9, 0.99)

SCHEMA = ("source string, file string, written timestamp, n_rows long, keys binary, lengths binary, min_len long, max_len long")


def file_sketches(name: str, df: DataFrame, keys: list[str], list_col: str | None = None) -> DataFrame:
    """One row of ``SCHEMA`` for each file that ``df``, a plain read of files, has rows of.

    Partial sketches are built in the tasks that read the rows; only they are shuffled.
    """
    size = F.size(list_col).cast("bigint") if list_col else F.lit(None).cast("bigint")
    key = F.to_json(F.struct(*keys)) if len(keys) > 1 else F.col(keys[0])
    rows = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("written"),
                     key.alias("_key"), size.alias("_len"))
    lengths = F.kll_sketch_agg_bigint("_len", KLL_SIZE) if list_col else F.lit(None).cast("binary")
    return rows.groupBy("file").agg(
        F.max("written").alias("written"), F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_agg("_key", LOG_REGISTERS).alias("keys"),
        lengths.alias("lengths"), F.min("_len").alias("min_len"), F.max("_len").alias("max_len")).select(
            F.lit(name).alias("source"), "file", "written", "n_rows", "keys", "lengths", "min_len", "max_len")


def update_sketches(spark: SparkSession, path: str, name: str, source: DataFrame, keys: list[str],
                    list_col: str | None = None) -> int:
    """Describe the files of ``source`` that ``path`` does not know yet; -> how many these were.

    A file counts as known with the time it was written, so one that was replaced
    is described again (the profile takes its latest row).  Which files there are
    is asked of the source without reading a column of it.
    """
    known = read_sketches(spark, path).where(F.col("source") == name).select("file", "written")
    there = source.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("written"))
    new = there.distinct().join(known, ["file", "written"], "left_anti")
    names = new.select(F.collect_list("file")).first()[0]  # file names of one update, as a reader needs them
    if not names:
        return 0
    rows = reliable_checkpoint(file_sketches(name, spark.read.schema(source.schema).parquet(*names), keys, list_col))
    rows.write.mode("append").parquet(path)
    return len(names)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """All rows of sketches; none if nothing was written yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def merged_profile(sketches: DataFrame) -> DataFrame:
    """source, n_files, n_rows, n_keys (estimate), min_len, max_len and the quantiles of the list lengths."""
    last = sketches.groupBy("source", "file").agg(F.max_by(F.struct("n_rows", "keys", "lengths", "min_len", "max_len"), "written").alias("s"))
    merged = last.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("s.n_rows").alias("n_rows"),
        F.hll_sketch_estimate(F.hll_union_agg("s.keys")).alias("n_keys"), F.min("s.min_len").alias("min_len"),
        F.max("s.max_len").alias("max_len"), F.kll_merge_agg_bigint("s.lengths").alias("_k"))
    quantile = lambda q: F.when(F.col("max_len").isNotNull(), F.kll_sketch_get_quantile_bigint("_k", F.lit(q)))
    return merged.select("source", "n_files", "n_rows", "n_keys", "min_len", "max_len",
                         *[quantile(q).alias(f"len_q{round(100 * q)}") for q in QUANTILES])
