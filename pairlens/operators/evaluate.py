"""Evaluation of scored pairs: the reference's metrics as aggregates.

Scored rows carry ``label`` (0/1), ``prediction`` (0/1) and ``p1`` (the
probability of class 1; ``p0`` = 1 - p1).  Every metric is one aggregate
over the scored rows.

* ``positive_logloss``: the reference's "logloss" -- mean of -ln(p1) over
  rows *predicted* positive; the label is not used.  NULL when no row is
  predicted positive (the reference fails there).
* ``logloss``: the usual binary log loss, p clipped to [eps, 1 - eps].
* ``accuracy``: share of rows with prediction = label (called "precision"
  in the reference's report).
* ``auc``: exact area under the ROC curve with ties counted one half,
  computed from per-score counts and a running sum of negatives, distributed
  (see ``operators.ordering``) beyond ``ONE_TASK`` distinct scores; no binning.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.operators.ordering import with_running_sum
from pairlens.session import reliable_checkpoint

EPS = 1e-15
#: Distinct scores up to which one task adds up the counts (a few MB).
ONE_TASK = 100_000


def positive_logloss(scored: DataFrame) -> DataFrame:
    pos = scored.filter("prediction = 1.0")
    return pos.agg(F.avg(-F.ln(F.col("p1"))).alias("logloss"),
                   F.count(F.lit(1)).alias("n_predicted_positive"))


def logloss(scored: DataFrame, eps: float = EPS) -> DataFrame:
    p = F.least(F.greatest(F.col("p1"), F.lit(eps)), F.lit(1 - eps))
    y = F.col("label").cast("double")
    return scored.agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("logloss_standard"),
                      F.count(F.lit(1)).alias("n_rows"))


def accuracy(scored: DataFrame) -> DataFrame:
    hit = (F.col("prediction").cast("long") == F.col("label").cast("long")).cast("long")
    return scored.agg(F.avg(hit.cast("double")).alias("accuracy"),
                      F.sum(hit).alias("n_correct"), F.count(F.lit(1)).alias("n_rows"))


def auc(scored: DataFrame, score: str | Column = "p1", label: str = "label") -> DataFrame:
    s = F.col(score) if isinstance(score, str) else score
    y = F.col(label).cast("int")
    per_score = scored.groupBy(s.alias("_s")).agg(
        F.sum((y == 1).cast("long")).alias("_pos"), F.sum((y == 0).cast("long")).alias("_neg"))
    ranked = _ranked(per_score)
    below = F.col("_neg_upto") - F.col("_neg")
    return ranked.agg(
        _area(below).alias("auc"), F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))


def _ranked(per_score: DataFrame) -> DataFrame:
    """Adds ``_neg_upto``: the negatives with this score ``_s`` or a lower one."""
    kept = reliable_checkpoint(per_score)
    if kept.count() > ONE_TASK:
        return with_running_sum(kept, [F.col("_s").asc()], F.col("_neg"), "_neg_upto")
    upto = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return kept.withColumn("_neg_upto", F.sum("_neg").over(upto))


def _area(below: Column) -> Column:
    """NULL when one of the classes has no row."""
    pairs = F.sum("_pos") * F.sum("_neg")
    return F.try_divide(F.sum(F.col("_pos") * (below + 0.5 * F.col("_neg"))), F.nullif(pairs, F.lit(0)))


class ExactAuc(Evaluator, DefaultParamsReadable, DefaultParamsWritable):
    """Area under the ROC curve of a model's raw scores for model selection, from ranks instead of bins.

    ``scoreCol`` is a number or a vector whose second component is the score of
    class 1.  Rows of one class only tell nothing: the value is then 0.5, so a
    search never prefers a point for it.
    """

    scoreCol = Param(Params._dummy(), "scoreCol", "score or raw prediction of class 1", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label, 0 or 1", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, scoreCol="rawPrediction", labelCol="label"):
        super().__init__()
        self._setDefault(scoreCol="rawPrediction", labelCol="label")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        name = self.getOrDefault(self.scoreCol)
        is_number = dict(dataset.dtypes)[name] in ("double", "float", "int", "bigint")
        score = F.col(name) if is_number else vector_to_array(name)[1]
        value = auc(dataset, score, self.getOrDefault(self.labelCol)).first()["auc"]
        return 0.5 if value is None else float(value)

    def isLargerBetter(self) -> bool:
        return True


def report(scored: DataFrame, app: str, score: str | Column = "p1") -> DataFrame:
    """The reference's conclusion as rows (app, metric, value):
    logloss (reference definition), auc, precision (= accuracy)."""
    s = F.col(score) if isinstance(score, str) else score
    y, predicted = F.col("label").cast("int"), F.col("prediction").cast("int")
    # The scored rows are read once; what follows works on one row per score.
    per_score = scored.groupBy(s.alias("_s")).agg(
        F.sum((y == 1).cast("long")).alias("_pos"), F.sum((y == 0).cast("long")).alias("_neg"),
        F.count(F.lit(1)).alias("_n"), F.sum((predicted == y).cast("long")).alias("_hit"),
        F.sum((predicted == 1).cast("long")).alias("_yes"),
        F.sum(F.when(predicted == 1, -F.ln(F.col("p1")))).alias("_loss"))
    ranked = _ranked(per_score)
    one = ranked.agg(
        F.try_divide(F.sum("_loss"), F.nullif(F.sum("_yes"), F.lit(0))).alias("logloss"),
        _area(F.col("_neg_upto") - F.col("_neg")).alias("auc"),
        F.try_divide(F.sum("_hit"), F.nullif(F.sum("_n"), F.lit(0))).alias("precision"))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                     for m in ("logloss", "auc", "precision")])
    return one.select(F.explode(rows).alias("r")).select(F.lit(app).alias("app"), "r.metric", "r.value")


def markdown_row(app: str, values: dict[str, float]) -> str:
    """Format the conclusion line the reference prints."""
    return (f"{app} -> logloss, areaUnderRoc, precision, | {values.get('logloss')} | "
            f"{values.get('auc')} | {values.get('precision')} | | |")


def rule_scorer(pf: DataFrame, feature: str = "jaccard_set", scale: float = 10.0,
                shift: float = 5.0) -> DataFrame:
    """Deterministic scorer p1 = logistic(scale * feature - shift).

    Used to exercise evaluation and output operators without a trained model
    so their results can be checked exactly; NaN features score as 0.
    """
    x = F.col(feature)
    x = F.when(F.isnan(x) | x.isNull(), F.lit(0.0)).otherwise(x)
    p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(scale) * x - F.lit(shift))))
    return (pf.withColumn("p1", p1)
              .withColumn("p0", F.lit(1.0) - F.col("p1"))
              .withColumn("prediction", F.when(F.col("p1") > 0.5, 1).otherwise(0)))
