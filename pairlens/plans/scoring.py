"""A fitted scorer that can be stored and loaded: basis, feature set, finite rule, classifier.

``PairScorer`` is an ML ``Transformer``.  It keeps everything that scoring needs
besides the data: the PCA basis of the word vectors, the feature set, the rule for
missing words, the ceiling of the finite rule and the fitted classifier.  ``bind``
gives it the questions and word vectors of a run; ``transform`` then scores pairs,
batch or streaming.  ``save`` and ``load`` use the ML persistence layout (one
``metadata`` folder, the parts beside it), so a new session scores without a fit.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import PCAModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators.colocated import Laid, can_bucket, hot_questions, lay_out
from pairlens.operators.pairs import kept_columns, metric_names, needs_sequence, pair_features
from pairlens.operators.vectors import in_groups, project, question_features
from pairlens.session import reliable_checkpoint

#: The largest feature value that models see.
CEILING = 1e6


def make_finite(pf: DataFrame, names: list[str], ceiling: float = CEILING) -> DataFrame:
    """The finite rule for the columns ``names``; ``replaced`` says whether it changed the row.

    NaN and NULL become 0, values beyond the ceiling become the ceiling.
    """
    odd = F.lit(False)
    out = {}
    for n in names:
        c = F.col(n).cast("double")
        none = c.isNull() | F.isnan(c)
        odd = odd | none | (F.abs(c) > ceiling)
        out[n] = F.when(none, F.lit(0.0)).otherwise(F.least(F.greatest(c, F.lit(-ceiling)), F.lit(ceiling)))
    return pf.withColumns({"replaced": odd, **out})


def with_probabilities(scored: DataFrame) -> DataFrame:
    """p0, p1 from the probability vector (NULL for models without one),
    ``score`` = margin of class 1 for ranking metrics."""
    cols = scored.columns
    if "probability" in cols:
        prob = vector_to_array("probability")
        scored = scored.withColumn("p0", prob[0]).withColumn("p1", prob[1])
    else:
        scored = scored.withColumn("p0", F.lit(None).cast("double")).withColumn("p1", F.lit(None).cast("double"))
    return scored.withColumn("score", vector_to_array("rawPrediction")[1])


class PairScorer(Transformer, MLReadable, MLWritable):
    """Scores (q1, q2) pairs by the questions it is bound to; every column of the pairs is kept."""

    featureSet = Param(Params._dummy(), "featureSet", "metrics of a pair, in the order of the feature vector",
                       TypeConverters.toListString)
    missing = Param(Params._dummy(), "missing", "rule for words without a vector", TypeConverters.toString)
    ceiling = Param(Params._dummy(), "ceiling", "largest absolute feature value", TypeConverters.toFloat)
    modelName = Param(Params._dummy(), "modelName", "name of the classifier", TypeConverters.toString)
    reduced = Param(Params._dummy(), "reduced", "whether word vectors are put on a basis first", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, featureSet=None, missing="zero", ceiling=CEILING, modelName="", reduced=False):
        super().__init__()
        self._setDefault(missing="zero", ceiling=CEILING, modelName="", reduced=False)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self.basis: PCAModel | None = None
        self.classifier: PipelineModel | None = None
        self.question_features: DataFrame | None = None
        self.laid: Laid | None = None

    @property
    def names(self) -> list[str]:
        return list(self.getOrDefault(self.featureSet))

    def with_parts(self, basis: PCAModel | None, classifier: PipelineModel | None) -> PairScorer:
        """A copy with these fitted parts."""
        out = self.copy()
        out.basis, out.classifier = basis, classifier
        return out._set(reduced=basis is not None)

    def bind(self, question: DataFrame, word_vec: DataFrame) -> PairScorer:
        """A copy that scores pairs of these questions.

        Their features are computed once and written to the shared checkpoint
        folder, by question where tables can be registered; every pair side and every
        micro-batch reads that copy, batches in place.
        """
        vectors = project(word_vec, self.basis) if self.basis is not None else word_vec
        columns = kept_columns(self.names)
        features = question_features(question, vectors, missing=self.getOrDefault(self.missing),
                                     sequence=needs_sequence(self.names), columns=columns)
        spark = features.sparkSession
        if not can_bucket(spark):
            return self.bind_features(reliable_checkpoint(features.select(*columns)))
        laid = lay_out(features.select(*columns), "qid", "features", in_groups=in_groups(columns, needs_sequence(self.names)))
        return self.bind_features(laid.plain(spark), laid)

    def bind_features(self, features: DataFrame, laid: Laid | None = None) -> PairScorer:
        """A copy that reads question features that are already there (``laid``: the same, laid out by question)."""
        out = self.copy()
        out.question_features, out.laid = features, laid
        return out

    def _features_for(self, pairs: DataFrame) -> DataFrame:
        """Question features as they are joined to ``pairs``: in place, but to be shuffled for a stream or where a question is hot."""
        if self.laid is None or pairs.isStreaming or hot_questions(pairs):
            return self.question_features
        return self.laid.in_place(pairs.sparkSession)

    def pair_features(self, pairs: DataFrame) -> DataFrame:
        """The pairs with their finite feature columns; a pair that names an unknown question is kept."""
        if self.question_features is None:
            raise ValueError("bind the scorer to questions and word vectors first")
        own = [c for c in pairs.columns if c not in ("q1", "q2", "label")]
        found = pair_features(pairs, self._features_for(pairs), self.names, how="left", keep=own)
        return make_finite(found, self.names, self.getOrDefault(self.ceiling))

    def classified(self, features: DataFrame) -> DataFrame:
        """Pairs that have their feature columns already (``pair_features``), scored."""
        if self.classifier is None:
            raise ValueError("the scorer has no fitted classifier")
        return with_probabilities(self.classifier.transform(features))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.classifier is None:
            raise ValueError("the scorer has no fitted classifier")
        return self.classified(self.pair_features(dataset))

    def copy(self, extra=None) -> PairScorer:
        out = super().copy(extra)
        out.basis, out.classifier, out.question_features, out.laid = self.basis, self.classifier, self.question_features, self.laid
        return out

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, scorer: PairScorer):
        super().__init__()
        self.scorer = scorer

    def saveImpl(self, path: str) -> None:
        if self.scorer.classifier is None:
            raise ValueError("only a fitted scorer can be saved")
        DefaultParamsWriter.saveMetadata(self.scorer, path, self.sparkSession)
        if self.scorer.basis is not None:
            self.scorer.basis.write().save(f"{path}/basis")
        self.scorer.classifier.write().save(f"{path}/classifier")


class _Reader(MLReader):
    def load(self, path: str) -> PairScorer:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        scorer = PairScorer()
        scorer._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(scorer, metadata)
        basis = PCAModel.load(f"{path}/basis") if scorer.getOrDefault(scorer.reduced) else None
        return scorer.with_parts(basis, PipelineModel.load(f"{path}/classifier"))


def new_scorer(feature_set, model: str, missing: str = "zero") -> PairScorer:
    return PairScorer(featureSet=metric_names(feature_set), modelName=model, missing=missing)
