"""The opN_* queries: each derives its contract's columns from its operator's result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import (alignment, bpe, countjoin, decontaminate, minhash, neighbours, pseudonyms, secrets, sharding,
                          spelling, suffixes, toxicity, wrappers)
from pairlens.llm.common import stored, table


def op1_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return wrappers.extract_pages(pages, stored(wrappers.infer_wrappers(pages), "wrappers"))


def word_bpe() -> str:
    """Place of the tokenizer file; installed beside the library on every node."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), word_bpe())


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


#: The key that the query uses; a real corpus is given a secret one.
DEMONSTRATION_KEY = b"demonstration key of the query op6"


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), DEMONSTRATION_KEY)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), n_shards=24)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and secret; the value itself is given by its digest only."""
    model = secrets.train(secrets.example_findings(spark))
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), model)
    return found.select("doc_id", "start", F.length("secret").cast("long").alias("n_chars"), "n_found",
                        F.sha2("secret", 256).alias("secret_sha256"), "probability")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80).drop("digest")


def op11_countjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countjoin.similarity_join(table(spark, sf_dir, "documents"), words=3, percent=90)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                      public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wrappers": op1_wrappers,
    "op2_bpe": op2_bpe,
    "op3_suffixes": op3_suffixes,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity": op5_toxicity,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_sharding": op7_sharding,
    "op8_secrets": op8_secrets,
    "op9_neighbours": op9_neighbours,
    "op10_minhash": op10_minhash,
    "op11_countjoin": op11_countjoin,
    "op12_spelling": op12_spelling,
    "op13_alignment": op13_alignment,
}

ORACLE: dict[str, str] = {}
