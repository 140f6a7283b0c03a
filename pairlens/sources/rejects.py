"""Reason-coded rejects of the text formats, counted in the pass that reads the rows.

``parse_lines`` turns every line of a file into the format's columns and a
``reason``: NULL for a row, else why the line is none.  ``read_counted`` gives
the rows together with an observation that Spark fills while the rows are read
for whatever they are needed; no second scan counts the dropped lines.
``read_rejects`` gives the rejected lines themselves.

Reasons, the first that fits a line:

* ``header``: the first field is the format's header word;
* ``fields``: not as many fields as the format has (an embedding needs a vector);
* ``id``: an id does not parse or is negative;
* ``list``: an element of an id list does not parse;
* ``number``: a vector component or label is not a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pairlens.functions.ids import decode_id, decode_id_list

REASONS = ("header", "fields", "id", "list", "number")


def _bad_id(*ids: str) -> Column:
    bad = F.lit(False)
    for i in ids:
        bad = bad | F.col(i).isNull() | (F.col(i) < 0)
    return bad


def _bad_list(*lists: str) -> Column:
    bad = F.lit(False)
    for c in lists:
        bad = bad | F.exists(c, lambda x: x.isNull())
    return bad


def _reason(**tests: Column) -> Column:
    out = F.lit(None).cast("string")
    for name in reversed(REASONS):
        if name in tests:
            out = F.when(tests[name], name).otherwise(out)
    return out


def _embeddings(lines: DataFrame, id_col: str) -> DataFrame:
    f = F.split(F.rtrim(F.col("value")), " ")
    parsed = lines.select("value", decode_id(f.getItem(0)).alias(id_col), F.transform(
        F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(0))), lambda x: x.try_cast("double")).alias("features"))
    return parsed.withColumn("reason", _reason(
        fields=F.size("features") == 0, id=_bad_id(id_col), number=F.exists("features", lambda x: x.isNull())))


def _questions(lines: DataFrame) -> DataFrame:
    f = F.split(F.col("value"), ",")
    parsed = lines.select("value", F.size(f).alias("_n"), f.getItem(0).alias("_first"), decode_id(f.getItem(0)).alias("qid"),
                          decode_id_list(F.coalesce(F.get(f, F.lit(1)), F.lit(""))).alias("word_ids"),
                          decode_id_list(F.coalesce(F.get(f, F.lit(2)), F.lit(""))).alias("char_ids"))
    return parsed.withColumn("reason", _reason(
        header=F.col("_first") == "qid", fields=F.col("_n") != 3, id=_bad_id("qid"), list=_bad_list("word_ids", "char_ids"))).drop("_n", "_first")


def _train_pairs(lines: DataFrame) -> DataFrame:
    f = F.split(F.col("value"), ",")
    parsed = lines.select("value", F.size(f).alias("_n"), f.getItem(0).alias("_first"),
                          f.getItem(0).try_cast("int").alias("label"), decode_id(F.get(f, F.lit(1))).alias("q1"),
                          decode_id(F.get(f, F.lit(2))).alias("q2"))
    return parsed.withColumn("reason", _reason(
        header=F.col("_first") == "label", fields=F.col("_n") != 3, id=_bad_id("q1", "q2"), number=F.col("label").isNull())).drop("_n", "_first")


def _test_pairs(lines: DataFrame) -> DataFrame:
    f = F.split(F.col("value"), ",")
    parsed = lines.select("value", F.size(f).alias("_n"), f.getItem(0).alias("_first"),
                          decode_id(f.getItem(0)).alias("q1"), decode_id(F.get(f, F.lit(1))).alias("q2"))
    return parsed.withColumn("reason", _reason(
        header=F.col("_first") == "q1", fields=F.col("_n") != 2, id=_bad_id("q1", "q2"))).drop("_n", "_first")


PARSERS = {
    "word_embed": lambda lines: _embeddings(lines, "wid"),
    "char_embed": lambda lines: _embeddings(lines, "cid"),
    "question": _questions,
    "train": _train_pairs,
    "test": _test_pairs,
}


def parse_lines(lines: DataFrame, kind: str) -> DataFrame:
    """(value, <columns of the format>, reason) of lines (value), batch or streaming."""
    if kind not in PARSERS:
        raise ValueError(f"unknown format {kind!r}; one of {sorted(PARSERS)}")
    return PARSERS[kind](lines)


def read_counted(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, Observation]:
    """-> (rows, counts): ``counts.get`` holds n_lines, n_rows and one count per reason after the rows' first action."""
    counts = Observation(f"lines of {kind}")
    parsed = parse_lines(spark.read.text(path), kind).observe(
        counts, F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("reason").isNull()).alias("n_rows"),
        *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])
    return parsed.where("reason is null").drop("value", "reason"), counts


def read_rejects(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(line, reason) of every line that is no row."""
    return parse_lines(spark.read.text(path), kind).where("reason is not null").select(F.col("value").alias("line"), "reason")


def check_rejects(counts: Observation, most: int | dict[str, int]) -> dict[str, int]:
    """The counts; fails if more lines were rejected than ``most`` (headers never count).

    ``most`` is a number for all reasons together or one per reason.
    """
    got = dict(counts.get)
    rejected = {r: got[r] for r in REASONS if r != "header"}
    if isinstance(most, int):
        if sum(rejected.values()) > most:
            raise ValueError(f"{sum(rejected.values())} of {got['n_lines']} lines rejected: {rejected}")
    else:
        over = {r: n for r, n in rejected.items() if n > most.get(r, 0)}
        if over:
            raise ValueError(f"rejected lines: {over} of {got['n_lines']}")
    return got
