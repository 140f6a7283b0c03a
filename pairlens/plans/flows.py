"""End-to-end flows of the reference, as one lazy plan up to each fit.

``train_evaluate``: reduce word vectors (PCA) -> per-question sums -> pair
features -> hold-out split -> cross-validated fit -> scored hold-out rows.
``predict``: fit on all train pairs, score the test pairs.

One rule for features that are not finite holds in fitting, hold-out and
scoring, and no row is dropped: NaN and NULL (a zero vector's cosine, two empty
texts' Jaccard) become 0, and everything beyond ``CEILING``, the Infinity of the
reference's "euclidean" of identical texts included, becomes ``CEILING``.  The
number of training rows this touches is reported.  Pairs that name an unknown
question fail a strict run with their count; otherwise they are kept and
scored by the same rule.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.operators.evaluate import report
from pairlens.operators.pairs import assert_known, dedupe_pairs, kept_columns, metric_names, needs_sequence, pair_features
from pairlens.operators.split import split, with_fold
from pairlens.operators.vectors import fit_basis, question_features, reduce_word_vectors
from pairlens.plans.models import NUM_FOLDS, PCA_K, cross_validator
from pairlens.plans.scoring import CEILING, PairScorer, make_finite, new_scorer, with_probabilities
from pairlens.session import reliable_checkpoint
from pairlens.sinks.files import output_paths, write_predictions, write_scored, write_submission
from pairlens.sources import text_formats as S

__all__ = ["CEILING", "make_finite", "with_probabilities", "feature_frame", "fit_scorer", "pair_side_features", "predict",
           "run_model", "score_pairs", "train_evaluate", "TrainResult"]

#: Rows of a training frame that one task of a fit goes through.
PARTITION_ROWS = 20_000


def pair_side_features(question: DataFrame, word_vec: DataFrame, names: list[str],
                       pca_k: int | None = None, missing: str = "zero") -> DataFrame:
    """Per-question features (after optional PCA of the word vectors),
    written once to the shared checkpoint folder: every pair side reads
    them instead of recomputing."""
    wv = reduce_word_vectors(word_vec, pca_k)[0] if pca_k else word_vec
    columns = kept_columns(names)
    qf = question_features(question, wv, missing=missing, sequence=needs_sequence(names), columns=columns)
    return reliable_checkpoint(qf.select(*columns))


def feature_frame(question: DataFrame, word_vec: DataFrame, pairs: DataFrame,
                  feature_set="all", pca_k: int | None = None, missing: str = "zero"):
    names = metric_names(feature_set)
    qf = pair_side_features(question, word_vec, names, pca_k, missing)
    return pair_features(pairs, qf, names), names


def persisted_training_frame(df: DataFrame):
    """Persist ``df`` (iterative fits read it many times) -> (frame, rows, rows changed by ``make_finite``).

    A fit is hundreds of jobs over these rows, each with one task per partition, so
    no more partitions are kept than have ``PARTITION_ROWS`` rows each.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    n, changed = kept.agg(F.count(F.lit(1)), F.sum(F.col("replaced").cast("long"))).first()
    wanted = max(1, -(-n // PARTITION_ROWS))
    if wanted < kept.rdd.getNumPartitions():
        wide, kept = kept, kept.coalesce(wanted).persist(StorageLevel.MEMORY_AND_DISK)
        kept.count()
        wide.unpersist()
    return kept, n, changed or 0


@dataclass
class TrainResult:
    model: CrossValidatorModel
    scored: DataFrame
    feature_cols: list[str]
    avg_metrics: list[float] = field(default_factory=list)
    n_train: int = 0
    n_replaced: int = 0
    scorer: PairScorer | None = None


def _pairs_of(pairs: DataFrame, question: DataFrame, strict: bool) -> DataFrame:
    if strict:
        assert_known(pairs, question)
    return pairs


def unfitted(question: DataFrame, word_vec: DataFrame, model: str, feature_set="all", pca_k: int | None = None) -> PairScorer:
    """A scorer with its basis, bound to the questions; only its classifier is still to be fitted."""
    k = pca_k if pca_k is not None else PCA_K[model]
    return new_scorer(feature_set, model).with_parts(fit_basis(word_vec, k) if k else None, None).bind(question, word_vec)


def _fitted(scorer: PairScorer, train: DataFrame, model: str, seed: int, params: dict | None):
    """-> (scorer with the best classifier, cross-validation model, training rows, rows changed by the finite rule)."""
    train, n, n_replaced = persisted_training_frame(with_fold(train, NUM_FOLDS, seed))
    try:
        cv_model = cross_validator(model, scorer.names, seed, params).fit(train)
    finally:
        train.unpersist()
    return scorer.with_parts(scorer.basis, cv_model.bestModel), cv_model, n, n_replaced


def unfitted_pairs(question: DataFrame, word_vec: DataFrame, train_pair: DataFrame, model: str, feature_set="all",
                   pca_k: int | None = None, strict: bool = True) -> tuple[PairScorer, DataFrame]:
    """-> (an unfitted scorer bound to the questions, every train pair with its features)."""
    scorer = unfitted(question, word_vec, model, feature_set, pca_k)
    return scorer, scorer.pair_features(_pairs_of(dedupe_pairs(train_pair), question, strict))


def train_evaluate(question: DataFrame, word_vec: DataFrame, train_pair: DataFrame, model: str = "lr",
                   feature_set="all", pca_k: int | None = None, seed: int = 42,
                   train_percent: int = 80, output: str | None = None, strict: bool = True,
                   params: dict | None = None, shared: tuple[PairScorer, DataFrame] | None = None) -> TrainResult:
    """``params`` overrides settings of the classifier, such as maxIter or maxDepth.

    ``shared`` is what ``unfitted_pairs`` gave for another model on the same tables,
    features and basis size; it is read instead of computed again.
    """
    if shared is None:
        scorer, features = unfitted_pairs(question, word_vec, train_pair, model, feature_set, pca_k, strict)
    else:
        bound, features = shared
        scorer = new_scorer(feature_set, model).with_parts(bound.basis, None).bind_features(bound.question_features, bound.laid)
    train, test = split(features, train_percent, seed)
    scorer, cv_model, n_train, n_replaced = _fitted(scorer, train, model, seed, params)
    scored = scorer.classified(test)
    if output:
        write_scored(scored, output)
    return TrainResult(cv_model, scored, scorer.names, list(cv_model.avgMetrics), n_train, n_replaced, scorer)


def fit_scorer(question: DataFrame, word_vec: DataFrame, train_pair: DataFrame, model: str = "lr", feature_set="all",
               pca_k: int | None = None, seed: int = 42, strict: bool = True, params: dict | None = None) -> PairScorer:
    """A scorer fitted on every train pair; ``save`` stores it, ``bind`` puts it on other questions."""
    scorer = unfitted(question, word_vec, model, feature_set, pca_k)
    pairs = _pairs_of(dedupe_pairs(train_pair), question, strict)
    return _fitted(scorer, scorer.pair_features(pairs), model, seed, params)[0]


def score_pairs(scorer: PairScorer, test_pair: DataFrame, question: DataFrame, output: str | None = None,
                strict: bool = True) -> DataFrame:
    """One scored row for each test row by a bound scorer, also for unknown questions with ``strict=False``."""
    scored = scorer.transform(_pairs_of(test_pair, question, strict).withColumn("label", F.lit(-1)))
    if output:
        write_predictions(scored, output)
    return scored


def predict(question: DataFrame, word_vec: DataFrame, train_pair: DataFrame, test_pair: DataFrame,
            model: str = "lr", feature_set="all", pca_k: int | None = None, seed: int = 42,
            output: str | None = None, strict: bool = True, params: dict | None = None) -> DataFrame:
    """Fit on every train pair, score every test pair -> prediction rows.

    Test pairs always use the same feature set as training (stored with the
    model), unlike the reference which always scores with the default set.
    There is one prediction for each test row, also with ``strict=False``.
    """
    scorer = fit_scorer(question, word_vec, train_pair, model, feature_set, pca_k, seed, strict, params)
    return score_pairs(scorer, test_pair, question, output, strict)


def run_model(spark: SparkSession, inputs: dict[str, str], base: str, model: str, evaluate: bool = True,
              unit: str = "word", scorer_path: str | None = None, **settings) -> dict[str, str]:
    """One model from the text files to its output folder; -> the paths written.

    ``inputs`` names the files: ``word_embed`` (or ``char_embed`` with
    ``unit='char'``, which sums character vectors instead), ``question``,
    ``train`` and, to predict, ``test``.  With ``evaluate`` the model is fitted on
    80 % of the pairs, the others are scored into ``cv_transformed`` and the
    conclusion is written to ``report``.  Otherwise it is fitted on all pairs (or
    loaded from ``scorer_path``), stored in ``scorer``, and the test pairs are
    scored into ``prediction`` and ``submission``.
    """
    paths = output_paths(base, model)
    vectors = S.read_embeddings(spark, inputs[f"{unit}_embed"])
    question = S.read_questions(spark, inputs["question"]).select("qid", F.col(f"{unit}_ids").alias("word_ids"))
    if evaluate:
        result = train_evaluate(question, vectors, S.read_train_pairs(spark, inputs["train"]), model=model,
                                output=paths["cv_transformed"], **settings)
        score = "score" if model == "svm" else "p1"
        report(spark.read.schema(result.scored.select("label", "prediction", "p1", "score").schema)
               .json(paths["cv_transformed"]), model, score).write.mode("overwrite").json(paths["report"])
        return {k: paths[k] for k in ("cv_transformed", "report")}
    if scorer_path:
        scorer = PairScorer.load(scorer_path).bind(question, vectors)
    else:
        scorer = fit_scorer(question, vectors, S.read_train_pairs(spark, inputs["train"]), model=model, **settings)
        scorer.write().overwrite().save(paths["scorer"])
    tests = S.read_test_pairs(spark, inputs["test"])
    score_pairs(scorer, tests, question, paths["prediction"], settings.get("strict", True))
    write_submission(tests, S.read_predictions(spark, paths["prediction"]), paths["submission"])
    return {k: paths[k] for k in ("prediction", "submission", *(() if scorer_path else ("scorer",)))}
