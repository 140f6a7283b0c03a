"""Score test-pair files as they arrive (Structured Streaming).

The batch ``predict`` step as a stream: new files in the test-pair text
format are parsed with the same column expressions as the batch reader,
joined to the (static) per-question features, scored by a stored scorer, any
fitted model or a column scorer, and written as prediction JSON lines.  Progress
lives in the checkpoint location, so a restarted query resumes after the last
committed file and a lost executor only replays the current micro-batch.

Batch scoring reads one table, in which a repeated pair is one pair; a stream may
meet a pair again in a later file.  With ``dedupe_within`` every pair is scored
once: the pairs seen are keyed state, kept until the watermark (the files' times
less that delay) has passed them, so state is bounded by the pairs of that time
and survives restarts.  ``by_batch`` writes every micro-batch into a folder of its
own number, overwriting it, so a replayed batch leaves no second copy, also where
files are read by something that does not know Spark's sink log.
"""

from __future__ import annotations

from typing import Callable

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions.ids import decode_id
from pairlens.operators.pairs import pair_features
from pairlens.plans.scoring import PairScorer, make_finite, with_probabilities
from pairlens.session import reliable_checkpoint
from pairlens.sinks.files import prediction_frame


def parse_test_pair_lines(lines: DataFrame) -> DataFrame:
    """(q1, q2) and the lines' other columns from text lines; header and malformed lines dropped."""
    f = F.split(F.col("value"), ",")
    others = [c for c in lines.columns if c != "value"]
    return (lines.select(f.getItem(0).alias("_first"), decode_id(f.getItem(0)).alias("q1"),
                         decode_id(f.getItem(1)).alias("q2"), *others)
                 .filter((F.col("_first") != "q1") & F.col("q1").isNotNull() & F.col("q2").isNotNull())
                 .drop("_first"))


def batch_folder(sink_dir: str, batch_id: int) -> str:
    return f"{sink_dir.rstrip('/')}/batch-{batch_id:012d}"


def score_stream(spark: SparkSession, source_dir: str, qf: DataFrame | None, feature_cols: list[str] | None,
                 sink_dir: str, checkpoint_location: str,
                 model: Transformer | None = None,
                 scorer: Callable[[DataFrame], DataFrame] | None = None,
                 available_now: bool = True, max_files: int = 1000,
                 dedupe_within: str | None = None, by_batch: bool = False):
    """Start the streaming query; returns the StreamingQuery.

    Exactly one of ``model`` (a bound ``PairScorer``, which needs neither ``qf``
    nor ``feature_cols``, or a fitted pipeline with an assembler over
    ``feature_cols``) or ``scorer`` (a function adding prediction, p0, p1)
    is used.  ``available_now`` processes what is there and stops.
    ``max_files`` bounds the files of one micro-batch.
    """
    if (model is None) == (scorer is None):
        raise ValueError("give exactly one of model or scorer")
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(source_dir)
    if dedupe_within:
        lines = lines.select("value", F.col("_metadata.file_modification_time").alias("arrived"))
    pairs = parse_test_pair_lines(lines).withColumn("label", F.lit(-1))
    if dedupe_within:
        pairs = pairs.withWatermark("arrived", dedupe_within).dropDuplicatesWithinWatermark(["q1", "q2"]).drop("arrived")
    if isinstance(model, PairScorer):
        scored = model.transform(pairs)
    else:
        # The static side is joined in every micro-batch: materialise it once in
        # the shared checkpoint folder instead of recomputing it per batch.
        # A pair that names an unknown question keeps its row and is scored by the same rule.
        pf = make_finite(pair_features(pairs, reliable_checkpoint(qf), feature_cols, how="left"), feature_cols)
        scored = scorer(pf) if scorer is not None else with_probabilities(model.transform(pf))
    out = prediction_frame(scored)
    if by_batch:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").json(batch_folder(sink_dir, batch_id))

        writer = out.writeStream.foreachBatch(write)
    else:
        writer = out.writeStream.format("json").option("path", sink_dir)
    writer = writer.outputMode("append").option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
