"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their oracles.

Every query reads the given tables of ``sf_dir`` (whole tables, whole
texts) and derives what it needs with Spark.  Output columns are scalars;
doubles are rounded to 6 decimals and non-finite values are reported in a
``*_kind`` column so both engines hash the same text.
"""

from __future__ import annotations

from functools import cached_property
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.operators import pairs as P
from pairlens.operators.colocated import features_for
from pairlens.operators.vectors import in_groups, question_features, question_vector_rows
from pairlens.plans.oracle_sql import EDIT_DISTANCE, recursive
from pairlens.plans.oracle_sql import kind as sql_kind
from pairlens.plans.oracle_sql import r6 as sql_r6
from pairlens.plans.oracle_sql import with_ctes
from pairlens.sources.testdata import prepare

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    finite = ~(F.isnan(c) | (c == float("inf")) | (c == float("-inf")))
    return F.when(finite, F.round(c, 6))


def kind(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.when(c.isNull(), "null").when(F.isnan(c), "nan")
            .when(c == float("inf"), "+inf").when(c == float("-inf"), "-inf")
            .otherwise("finite"))


class Context:
    """Derived tables of one scale factor, shared by the steps of a query."""

    def __init__(self, spark: SparkSession, sf_dir: str, missing: str = "zero"):
        self.spark = spark
        self.fx = prepare(spark, sf_dir)
        self.missing = missing
        self._cache: dict = {}

    @cached_property
    def question(self) -> DataFrame:
        return self.fx.question()

    @cached_property
    def word_vec(self) -> DataFrame:
        return self.fx.word_vec

    @cached_property
    def qf(self) -> DataFrame:
        """Per-question features for a single use (no materialisation)."""
        return question_features(self.question, self.word_vec, missing=self.missing)

    def pair_qf(self, names) -> DataFrame:
        """Per-question features joined to both pair sides: pruned to the
        columns ``names`` read, computed once and written to the shared
        checkpoint folder by question, so the two pair joins read one copy
        in place instead of recomputing or shuffling it."""
        cols = tuple(P.kept_columns(names))
        if cols not in self._cache:
            qf = question_features(self.question, self.word_vec, missing=self.missing,
                                   sequence=P.needs_sequence(names), columns=list(cols))
            self._cache[cols] = features_for(qf.select(*cols), self.fx.hot, in_groups(list(cols), P.needs_sequence(names)))
        return self._cache[cols]

    @cached_property
    def pairs(self) -> DataFrame:
        return P.dedupe_pairs(self.fx.train_pair)

    def features(self, names) -> DataFrame:
        return P.pair_features(self.pairs, self.pair_qf(names), names)


def with_unknown(pairs: DataFrame) -> DataFrame:
    """``pairs`` and some that name questions which do not exist (negative ids)."""
    odd = pairs.filter("q1 % 40 = 0")
    return (pairs.unionByName(odd.select("q1", (-1 - F.col("q2")).alias("q2")))
            .unionByName(odd.select((-1 - F.col("q1")).alias("q1"), "q2")))


def _metric_query(names: list[str], with_kind: tuple[str, ...] = ()) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pf = Context(spark, sf_dir).features(names)
        cols = [F.col("q1"), F.col("q2"), F.col("label")]
        for n in names:
            cols.append(r6(n).alias(n))
            if n in with_kind:
                cols.append(kind(n).alias(f"{n}_kind"))
        return pf.select(*cols)
    return run


def _metric_sql(names: list[str], source: str, with_kind: tuple[str, ...] = ()) -> str:
    cols = ["q1", "q2", "label"]
    for n in names:
        cols.append(f"{sql_r6(n)} AS {n}")
        if n in with_kind:
            cols.append(f"{sql_kind(n)} AS {n}_kind")
    return with_ctes(f"SELECT {', '.join(cols)} FROM {source}", source)


# -- step 1: derived tables ------------------------------------------------------

@register("vocabulary", with_ctes("SELECT w, n, wid FROM voc", "voc"))
def q_vocabulary(spark, sf_dir):
    return prepare(spark, sf_dir).vocab.select("w", "n", "wid")


@register("question_words", with_ctes(
    "SELECT qid, pos, wid FROM tokv", "tokv"))
def q_question_words(spark, sf_dir):
    q = prepare(spark, sf_dir).question()
    return q.select("qid", F.posexplode("word_ids").alias("pos", "wid")) \
        .withColumn("pos", F.col("pos").cast("bigint"))


@register("pair_dedupe", with_ctes("SELECT label, q1, q2 FROM pair", "pair"))
def q_pair_dedupe(spark, sf_dir):
    return P.dedupe_pairs(prepare(spark, sf_dir).train_pair).select("label", "q1", "q2")


# -- step 2: per-question vectors --------------------------------------------------

@register("question_vector", with_ctes(
    f"SELECT qid, dim, {sql_r6('value')} AS value FROM qvec", "qvec"))
def q_question_vector(spark, sf_dir):
    rows = question_vector_rows(Context(spark, sf_dir).qf)
    return rows.select("qid", "dim", r6("value").alias("value"))


@register("question_vector_truncate", with_ctes(
    f"SELECT v.qid, v.dim, {sql_r6('v.value')} AS value FROM qvec v JOIN qmiss m ON m.qid = v.qid "
    "WHERE m.n_missing = 0 OR v.dim = 0", "qvec", "qmiss"))
def q_question_vector_truncate(spark, sf_dir):
    rows = question_vector_rows(Context(spark, sf_dir, missing="truncate").qf)
    return rows.select("qid", "dim", r6("value").alias("value"))


@register("missing_words", with_ctes("SELECT qid, n_words, n_missing FROM qmiss", "qmiss"))
def q_missing_words(spark, sf_dir):
    qf = Context(spark, sf_dir).qf
    return qf.select("qid", F.col("n_words").cast("bigint").alias("n_words"),
                     F.col("n_missing").cast("bigint").alias("n_missing"))


# -- step 3: vector metrics ------------------------------------------------------------

register("pair_dot", _metric_sql(["dot"], "pmetric"))(_metric_query(["dot"]))
register("pair_cosine", _metric_sql(["cosine"], "pmetric", ("cosine",)))(
    _metric_query(["cosine"], ("cosine",)))
register("pair_manhattan", _metric_sql(["manhattan"], "pmetric"))(_metric_query(["manhattan"]))
register("pair_chebyshev", _metric_sql(["chebyshev"], "pmetric"))(_metric_query(["chebyshev"]))
register("pair_euclidean_l2", _metric_sql(["euclidean_l2"], "pmetric"))(
    _metric_query(["euclidean_l2"]))


@register("pair_norm", with_ctes(
    f"SELECT q1, q2, label, {sql_r6('norm1')} AS norm1, {sql_r6('norm2')} AS norm2 FROM pmetric",
    "pmetric"))
def q_pair_norm(spark, sf_dir):
    ctx = Context(spark, sf_dir)
    j = P.join_questions(ctx.pairs, ctx.pair_qf(["cosine"]))
    return j.select("q1", "q2", "label", r6("a_norm").alias("norm1"), r6("b_norm").alias("norm2"))


@register("pair_euclidean", with_ctes(
    f"SELECT q1, q2, label, {sql_r6('euclidean')} AS euclidean, {sql_kind('euclidean')} AS euclidean_kind, "
    f"{sql_r6('log10(euclidean)')} AS euclidean_log10, {sql_r6('ssd')} AS squared_distance FROM pmetric",
    "pmetric"))
def q_pair_euclidean(spark, sf_dir):
    ctx = Context(spark, sf_dir)
    j = P.join_questions(ctx.pairs, ctx.pair_qf(["euclidean"]))
    e = P.METRICS["euclidean"]()
    return j.select("q1", "q2", "label", r6(e).alias("euclidean"), kind(e).alias("euclidean_kind"),
                    r6(F.log10(e)).alias("euclidean_log10"),
                    r6(P.M.squared_distance("a_features", "b_features")).alias("squared_distance"))


# -- step 4: sequence metrics ------------------------------------------------------------

register("pair_jaccard", _metric_sql(["jaccard"], "pjac", ("jaccard",)))(
    _metric_query(["jaccard"], ("jaccard",)))
register("pair_jaccard_set", _metric_sql(["jaccard_set"], "pjac", ("jaccard_set",)))(
    _metric_query(["jaccard_set"], ("jaccard_set",)))


@register("pair_lengths", with_ctes("SELECT q1, q2, label, q1_length, q2_length FROM pjac", "pjac"))
def q_pair_lengths(spark, sf_dir):
    pf = Context(spark, sf_dir).features(["q1_length", "q2_length"])
    return pf.select("q1", "q2", "label", F.col("q1_length").cast("bigint").alias("q1_length"),
                     F.col("q2_length").cast("bigint").alias("q2_length"))


@register("pair_edit_distance", recursive(EDIT_DISTANCE, "pair", "question"))
def q_pair_edit_distance(spark, sf_dir):
    pf = Context(spark, sf_dir).features(["edit_distance"])
    return pf.select("q1", "q2", "label", "edit_distance")


@register("pair_unknown_questions", with_ctes(
    "SELECT p.q1, p.q2, 'q1' AS missing_side FROM asked p WHERE p.q1 NOT IN (SELECT qid FROM question) "
    "UNION ALL SELECT p.q1, p.q2, 'q2' AS missing_side FROM asked p "
    "WHERE p.q2 NOT IN (SELECT qid FROM question)", "asked", "question"))
def q_pair_unknown_questions(spark, sf_dir):
    ctx = Context(spark, sf_dir)
    return P.unknown_questions(with_unknown(ctx.pairs.select("q1", "q2")), ctx.question)


# -- step 5: feature sets --------------------------------------------------------------------

_KIND = {"cosine", "euclidean", "jaccard"}
_SOURCE = {"cosine": "pfeat", "chebyshev": "pfeat", "manhattan": "pfeat", "euclidean": "pfeat",
           "jaccard": "pfeat"}


def _feature_set_sql(names: list[str]) -> str:
    cols = ["m.q1", "m.q2", "m.label"]
    for n in names:
        src = "j" if n == "jaccard" else "m"
        cols.append(f"{sql_r6(f'{src}.{n}')} AS {n}")
        if n in _KIND:
            cols.append(f"{sql_kind(f'{src}.{n}')} AS {n}_kind")
    return with_ctes(f"SELECT {', '.join(cols)} FROM pmetric m JOIN pjac j ON j.q1 = m.q1 AND j.q2 = m.q2",
                     "pmetric", "pjac")


for _set, _names in P.FEATURE_SETS.items():
    register(f"pair_features_{_set}", _feature_set_sql(_names))(
        _metric_query(_names, tuple(n for n in _names if n in _KIND)))


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the reference's default feature set for every train pair."""
    return QUERIES["pair_features_all"](spark, sf_dir)


# Second half of the registry (files, evaluation, models, profile, dates,
# streaming); imported last because it registers through this module.
from pairlens.plans import catalog_more  # noqa: E402,F401
