"""Classifiers, parameter grids and cross-validation (MLlib).

The four models of the reference with its settings.  Two settings cannot
be kept as written:

* GBT impurity "entropy" is rejected by MLlib's GBT (regression trees fit
  the gradients); the default "variance" is used.
* the perceptron's first layer must equal the number of features; the
  reference hard-codes 5 for a 4-feature set, so layer 0 is derived.

Points of a grid are compared by the exact AUC of each fold for all four models
(ties one half, no bins).  The reference takes F1 for the perceptron, whose grid
has one point, so the choice is the same.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.ml import Pipeline
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

from pairlens.operators.evaluate import ExactAuc

# Model settings of the reference.
PCA_K = {"base": 64, "lr": 16, "gbt": 8, "svm": 8, "mlp": 8}
LR_REG_PARAMS = [0.01, 0.1, 0.2, 0.5, 1.0]
NUM_FOLDS = 3
CV_PARALLELISM = 2
MODELS = ("lr", "gbt", "svm", "mlp")


class _NoSummary:
    """Fitted models without their training summary.

    A summary keeps the training frame and the session; a session that has
    observed metrics cannot be sent to tasks, and the model's scoring would be.
    """

    def _create_model(self, java_model):
        java_model.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
        return super()._create_model(java_model)


class PlainLogisticRegression(_NoSummary, LogisticRegression):
    pass


class PlainLinearSVC(_NoSummary, LinearSVC):
    pass


class PlainPerceptron(_NoSummary, MultilayerPerceptronClassifier):
    pass


def classifier(model: str, n_features: int, seed: int = 42):
    """-> (estimator, param maps); fixed values: the reference's settings of each model."""
    if model == "lr":
        est = PlainLogisticRegression(maxIter=10, standardization=True, elasticNetParam=0.95,
                                      fitIntercept=True, labelCol="label", featuresCol="features")
        grid = ParamGridBuilder().addGrid(est.regParam, LR_REG_PARAMS).build()
        return est, grid
    if model == "gbt":
        est = GBTClassifier(maxIter=10, minInstancesPerNode=5, stepSize=0.01, subsamplingRate=1.0,
                            maxDepth=5, featureSubsetStrategy="all", seed=seed,
                            labelCol="label", featuresCol="features")
        return est, ParamGridBuilder().build()
    if model == "svm":
        est = PlainLinearSVC(maxIter=10, standardization=True, fitIntercept=True,
                             labelCol="label", featuresCol="features")
        return est, ParamGridBuilder().build()
    if model == "mlp":
        est = PlainPerceptron(layers=[n_features, 7, 5, 2], maxIter=20, solver="gd", stepSize=0.1, blockSize=128,
                              seed=seed, labelCol="label", featuresCol="features")
        return est, ParamGridBuilder().build()
    raise ValueError(f"unknown model {model!r}; one of {MODELS}")


def cross_validator(model: str, feature_cols: list[str], seed: int = 42,
                    params: dict | None = None) -> CrossValidator:
    """Pipeline(assembler, classifier) under 3-fold cross-validation on the rows' ``fold``."""
    est, grid = classifier(model, len(feature_cols), seed)
    est.setParams(**(params or {}))
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=feature_cols, outputCol="features"), est])
    return CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=ExactAuc(),
                          numFolds=NUM_FOLDS, parallelism=CV_PARALLELISM, seed=seed, foldCol="fold")
