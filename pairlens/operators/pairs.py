"""Pair operators: dedupe, the two question joins, metric projection.

After one join per side every metric of a pair is a column of the same
row, so all of them come out of one projection; there is no per-metric
pass and no regrouping of partial results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions import metrics as M
from pairlens.functions.edit_distance import edit_distance

# Metric name -> expression over the joined pair row (a_* = q1 side, b_* = q2).
METRICS = {
    "cosine": lambda: M.cosine("a_features", "b_features", "a_norm", "b_norm"),
    "chebyshev": lambda: M.chebyshev("a_features", "b_features"),
    "manhattan": lambda: M.manhattan("a_features", "b_features"),
    "euclidean": lambda: M.euclidean("a_features", "b_features"),
    "euclidean_l2": lambda: M.euclidean_l2("a_features", "b_features"),
    "dot": lambda: M.dot("a_features", "b_features"),
    "jaccard": lambda: M.jaccard_repeats("a_words", "b_words", "a_repeats", "b_repeats", "a_odd_repeats", "b_odd_repeats"),
    "jaccard_set": lambda: M.jaccard_set("a_words", "b_words"),
    "edit_distance": lambda: edit_distance("a_word_ids", "b_word_ids"),
    "q1_length": lambda: F.col("a_n_words"),
    "q2_length": lambda: F.col("b_n_words"),
}

# Per-question columns each metric reads (both sides).
METRIC_INPUTS = {
    "cosine": ("features", "norm"), "chebyshev": ("features",), "manhattan": ("features",),
    "euclidean": ("features",), "euclidean_l2": ("features",), "dot": ("features",),
    "jaccard": ("words", "repeats", "odd_repeats"), "jaccard_set": ("words",), "edit_distance": ("word_ids",),
    "q1_length": ("n_words",), "q2_length": ("n_words",),
}

# Metrics that need the ordered word sequence (question_features(sequence=True)).
SEQUENCE_METRICS = {"edit_distance"}


def needs_sequence(feature_set) -> bool:
    return bool(SEQUENCE_METRICS & set(metric_names(feature_set)))


def question_columns(feature_set) -> list[str]:
    """qid plus the per-question columns the selected metrics read; used to
    prune question features before they are materialised."""
    cols = ["qid"]
    for n in metric_names(feature_set):
        cols += [c for c in METRIC_INPUTS[n] if c not in cols]
    return cols


def kept_columns(feature_set) -> list[str]:
    """``question_columns`` as they are written and sent to pairs: counts of words, of which the pair makes the repeats."""
    return list(dict.fromkeys("counts" if c in ("repeats", "odd_repeats") else c for c in question_columns(feature_set)))


# The feature sets of the reference and the order of the
# metrics inside the assembled vector.
FEATURE_SETS = {
    "all": ["cosine", "chebyshev", "jaccard", "manhattan"],
    "angel": ["cosine"],
    "chebyshev": ["chebyshev"],
    "jaccard": ["jaccard"],
    "mahattan": ["manhattan"],
    "euclidean": ["euclidean"],
}


def metric_names(feature_set) -> list[str]:
    """A feature-set name or an explicit list of metric names."""
    if isinstance(feature_set, str):
        names = FEATURE_SETS.get(feature_set, [feature_set])  # a single metric is a set of its own
    else:
        names = list(feature_set)
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    return names


def dedupe_pairs(pairs: DataFrame) -> DataFrame:
    """One row per ordered (q1, q2); a repeated pair keeps its smallest label.

    The aggregate is partial, so a pair repeated many times is combined in
    the map tasks before the shuffle.
    """
    if "label" not in pairs.columns:
        return pairs.select("q1", "q2").distinct()
    return pairs.groupBy("q1", "q2").agg(F.min("label").alias("label"))


def _side(qf: DataFrame, prefix: str, key: str) -> DataFrame:
    return qf.select(F.col("qid").alias(key),
                     *[F.col(c).alias(f"{prefix}_{c}") for c in qf.columns if c != "qid"])


def join_questions(pairs: DataFrame, qf: DataFrame, how: str = "inner") -> DataFrame:
    """Attach both questions' features to each pair.

    ``how='inner'`` drops pairs naming an unknown question, ``'left'`` keeps
    them with NULL features.  Plain equi-joins: adaptive execution splits the
    partitions of a question that very many pairs name, on either side.
    """
    return pairs.join(_side(qf, "a", "q1"), "q1", how).join(_side(qf, "b", "q2"), "q2", how)


def unknown_questions(pairs: DataFrame, question: DataFrame) -> DataFrame:
    """Pairs naming a question that does not exist (both anti-join sides)."""
    known = question.select("qid")
    miss1 = pairs.join(known.withColumnRenamed("qid", "q1"), "q1", "left_anti") \
        .select("q1", "q2", F.lit("q1").alias("missing_side"))
    miss2 = pairs.join(known.withColumnRenamed("qid", "q2"), "q2", "left_anti") \
        .select("q1", "q2", F.lit("q2").alias("missing_side"))
    return miss1.unionByName(miss2)


def assert_known(pairs: DataFrame, question: DataFrame) -> None:
    """Strict mode: fail with the count of pairs naming unknown questions."""
    n = unknown_questions(pairs, question).count()
    if n:
        raise ValueError(f"{n} pair sides name a question that does not exist")


#: Metrics by the columns that question features have where those of ``METRIC_INPUTS`` were not asked for.
_BY_TAGS = {"jaccard": lambda: M.jaccard("a_words", "b_words", "a_tags", "b_tags")}
_BY_COUNTS = {"jaccard": lambda: M.jaccard_counts("a_words", "b_words", "a_counts", "b_counts")}


def metric_columns(names, columns: list[str]) -> list[Column]:
    """The metrics of question features that have these columns."""
    by = METRICS | ({} if "repeats" in columns else _BY_COUNTS if "counts" in columns else _BY_TAGS if "tags" in columns else {})
    return [by[n]().alias(n) for n in names]


def pair_features(pairs: DataFrame, qf: DataFrame, feature_set="all", how: str = "inner",
                  keep: list[str] | None = None) -> DataFrame:
    """(q1, q2[, label], <metric columns>) for every pair."""
    names = metric_names(feature_set)
    if needs_sequence(names) and "word_ids" not in qf.columns:
        raise ValueError("edit distance needs question_features(..., sequence=True)")
    base = [c for c in ("q1", "q2", "label") if c in pairs.columns] + list(keep or [])
    joined = join_questions(pairs, qf, how)
    return joined.select(*base, *metric_columns(names, qf.columns))
