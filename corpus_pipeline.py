"""The corpus pipeline: five stages, each one operator over all that the stage before kept.

Every stage but the last returns the columns of ``documents``; each result is
written as Parquet and read again as the next stage's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import bpe, decontaminate, minhash, secrets, toxicity
from pairlens.llm.common import stored, table
from pairlens.llm.queries import word_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores 0.5 or more go; it learns from the labels that are not held out.

    A null or empty text is scored like any other; rows that repeat an id are judged by their own texts.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, 0.8).

    Rows without words or without doc_id stay; of rows that repeat an id only those whose text goes are dropped.
    """
    return minhash.drop_near_duplicates(docs, words=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows without doc_id and all rows beside an empty benchmark stay."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, whatever the ids of their rows; every document stays."""
    model = secrets.train(secrets.example_findings(spark))
    return secrets.redact(docs, model)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row; a null or empty text has no ids."""
    encoded = bpe.encode_documents(docs, word_bpe())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: The trained stages cannot be expressed in SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document that the filtering stages keep; an empty table gives an empty result.

    Columns of ``documents`` that no stage reads are carried along, whatever their names.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
