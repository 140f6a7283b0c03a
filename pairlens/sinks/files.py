"""Writers: the reference's text formats, scored rows, predictions, submission.

Every writer is a distributed ``DataFrame.write``; nothing is collected.
Files are written as part files of a folder.  Where order matters (test
pairs, submission) the frame is sorted first, which range-partitions it, so
part files in name order hold the rows in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens import schema as S
from pairlens.functions.dates import stamp
from pairlens.functions.ids import encode_id, encode_id_list

# The id prefixes used when writing the reference's formats
# (any single character is accepted when reading) and the output folders of
# each model.
WORD_PREFIX, CHAR_PREFIX, QUESTION_PREFIX = "W", "L", "Q"
MODEL_HOMES = {"lr": "output/lr", "gbt": "output/gbt", "svm": "output/svm", "mlp": "output/lmpc"}


def _text(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    df.write.mode(mode).text(path, compression=compression)


def write_embeddings(vec: DataFrame, path: str, id_col: str = "wid",
                     prefix: str = WORD_PREFIX) -> None:
    line = F.concat_ws(" ", encode_id(prefix, id_col),
                       F.array_join(F.transform("features", lambda x: x.cast("string")), " "))
    _text(vec.select(line.alias("value")), path)


def write_questions(question: DataFrame, path: str, compression: str = "none") -> None:
    """``compression`` is a codec of Spark's text files (``gzip``): the lines take about ten times the texts' room."""
    chars = F.col("char_ids") if "char_ids" in question.columns else F.array().cast("array<bigint>")
    line = F.concat_ws(",", encode_id(QUESTION_PREFIX, "qid"),
                       encode_id_list(WORD_PREFIX, "word_ids"), encode_id_list(CHAR_PREFIX, chars))
    header = question.sparkSession.createDataFrame([("qid,words,chars",)], "value string")
    _text(header.unionByName(question.select(line.alias("value"))), path, compression=compression)


def write_train_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select(F.col("label").cast("string").alias("label"),
                 encode_id(QUESTION_PREFIX, "q1").alias("q1"),
                 encode_id(QUESTION_PREFIX, "q2").alias("q2")) \
        .write.mode("overwrite").option("header", True).csv(path)


def write_test_pairs(pairs: DataFrame, path: str) -> None:
    """Ordered by row_no; each part file starts with the header line."""
    (pairs.orderBy("row_no")
          .select(encode_id(QUESTION_PREFIX, "q1").alias("q1"),
                  encode_id(QUESTION_PREFIX, "q2").alias("q2"))
          .write.mode("overwrite").option("header", True).csv(path))


def write_scored(scored: DataFrame, path: str) -> None:
    """Held-out rows with model outputs (vectors serialise as JSON objects)."""
    scored.write.mode("overwrite").json(path)


def prediction_frame(scored: DataFrame) -> DataFrame:
    """Select the fixed prediction schema from scored pairs (p0/p1 columns
    present, prediction as double or int); one stamp per query."""
    return scored.select(
        F.col("q1").cast("bigint").alias("q1"),
        F.col("q2").cast("bigint").alias("q2"),
        F.col("prediction").cast("int").alias("prediction"),
        F.col("p0").cast("double").alias("p0"),
        F.col("p1").cast("double").alias("p1"),
        stamp().alias("create_time"))


def write_predictions(scored: DataFrame, path: str, fmt: str = "json") -> None:
    out = prediction_frame(scored)
    out.write.mode("overwrite").format(fmt).save(path)


def submission_frame(test_pairs: DataFrame, predictions: DataFrame, strict: bool = True) -> DataFrame:
    """(row_no, y_pre): p1 of each test row, joined on (q1, q2).

    A pair repeated in the test file gets a line per occurrence; of repeated
    predictions the largest p1 counts.  With ``strict`` a test row without
    prediction fails the job that reads the result instead of giving an empty
    line.
    """
    pred = predictions.groupBy("q1", "q2").agg(F.max("p1").alias("p1"), F.lit(True).alias("found"))
    joined = test_pairs.join(pred, ["q1", "q2"], "left")
    value = F.col("p1")
    if strict:
        value = F.when(F.col("found").isNull(), F.raise_error(F.concat(
            F.lit("no prediction for test row "), F.col("row_no").cast("string"))).cast("double")).otherwise(value)
    return joined.select("row_no", value.alias("y_pre"))


def write_submission(test_pairs: DataFrame, predictions: DataFrame, path: str,
                     strict: bool = True) -> None:
    """CSV with one header ``y_pre``; part files in name order, joined, are the file in test order."""
    sub = submission_frame(test_pairs, predictions, strict)
    lines = sub.select("row_no", F.coalesce(F.col("y_pre").cast("string"), F.lit("")).alias("value"))
    header = sub.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("row_no"), F.lit("y_pre").alias("value"))
    header.unionByName(lines).orderBy("row_no").select("value").write.mode("overwrite").text(path)


def model_home(base: str, model: str) -> str:
    return f"{base.rstrip('/')}/{MODEL_HOMES[model]}"


def output_paths(base: str, model: str) -> dict[str, str]:
    home = model_home(base, model)
    return {name: f"{home}/{name}" for name in ("cv_transformed", "prediction", "report", "scorer", "submission")}
