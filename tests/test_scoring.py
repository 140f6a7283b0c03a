"""The stored scorer: the same rows after a save and a load, batch and stream; runs from text files."""
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from pairlens.plans import flows
from pairlens.plans.scoring import PairScorer, new_scorer
from pairlens.sinks import files as K
from pairlens.sources import text_formats as S
from pairlens.sources.testdata import prepare
from pairlens.streaming.score import score_stream


def by_pair(df):
    return {(r.q1, r.q2): r.p1 for r in df.select("q1", "q2", "p1").collect()}


@pytest.fixture(scope="module")
def fx(spark):
    return prepare(spark, SMALL)


@pytest.fixture(scope="module")
def fitted(spark, fx):
    return flows.fit_scorer(fx.question(), fx.word_vec, fx.train_pair, model="lr", feature_set=["cosine", "jaccard"], pca_k=4)


def test_saved_scorer_scores_the_same(spark, fx, fitted, tmp_out):
    fitted.write().overwrite().save(f"{tmp_out}/scorer")
    fitted.write().overwrite().save(f"{tmp_out}/scorer")  # over itself
    loaded = PairScorer.load(f"{tmp_out}/scorer")
    assert loaded.uid == fitted.uid and loaded.names == ["cosine", "jaccard"]
    assert loaded.getOrDefault(loaded.modelName) == "lr" and loaded.getOrDefault(loaded.ceiling) == 1e6
    assert loaded.basis.pc == fitted.basis.pc and loaded.question_features is None
    before = by_pair(flows.score_pairs(fitted, fx.test_pair, fx.question()))
    bound = loaded.bind(fx.question(), fx.word_vec)
    after = by_pair(flows.score_pairs(bound, fx.test_pair, fx.question()))
    assert before.keys() == after.keys() and all(abs(before[k] - after[k]) <= 1e-9 for k in before)
    # The same rows from a stream of their files.
    K.write_test_pairs(fx.test_pair, f"{tmp_out}/in")
    score_stream(spark, f"{tmp_out}/in", None, None, f"{tmp_out}/out", f"{tmp_out}/ckpt", model=bound).awaitTermination()
    streamed = by_pair(S.read_predictions(spark, f"{tmp_out}/out"))
    assert streamed.keys() == before.keys() and all(abs(before[k] - streamed[k]) <= 1e-9 for k in before)


def test_a_new_session_loads_it(spark, fitted, tmp_out):
    fitted.save(f"{tmp_out}/scorer")
    other = spark.newSession()
    question = other.createDataFrame([(1, [0, 1, 2]), (2, [0, 1, 2]), (3, [])], "qid bigint, word_ids array<bigint>")
    vectors = other.read.parquet(f"{SMALL}/embeddings.parquet").select(
        F.col("vec_id").alias("wid"), F.col("embedding").cast("array<double>").alias("features"))
    pairs = other.createDataFrame([(1, 2, "a"), (1, 3, "b"), (1, 99, "c")], "q1 bigint, q2 bigint, note string")
    rows = PairScorer.load(f"{tmp_out}/scorer").bind(question, vectors).transform(pairs).collect()
    assert {r.note for r in rows} == {"a", "b", "c"}  # columns and pairs with an unknown question stay
    assert all(abs(r.p0 + r.p1 - 1) < 1e-12 and r.prediction == float(r.p1 > r.p0) for r in rows)
    assert next(r for r in rows if r.note == "a").p1 > next(r for r in rows if r.note == "b").p1


def test_unbound_and_unfitted_scorers_fail(spark, fitted, tmp_out):
    pairs = spark.createDataFrame([(1, 2)], "q1 bigint, q2 bigint")
    with pytest.raises(ValueError, match="bind"):
        PairScorer(featureSet=["cosine"]).with_parts(None, fitted.classifier).transform(pairs)
    with pytest.raises(ValueError, match="fitted"):
        new_scorer("all", "lr").transform(pairs)
    with pytest.raises(ValueError, match="fitted"):
        new_scorer("all", "lr").write().save(f"{tmp_out}/none")


def test_run_model_from_files(spark, fx, tmp_out):
    inputs = {n: f"{tmp_out}/{n}" for n in ("word_embed", "question", "train", "test")}
    K.write_embeddings(fx.word_vec, inputs["word_embed"])
    K.write_questions(fx.question(), inputs["question"])
    K.write_train_pairs(fx.train_pair, inputs["train"])
    K.write_test_pairs(fx.test_pair, inputs["test"])
    home = f"{tmp_out}/home"
    done = flows.run_model(spark, inputs, home, "svm", params={"maxIter": 2})
    assert done["cv_transformed"] == f"{home}/output/svm/cv_transformed" and set(done) == {"cv_transformed", "report"}
    report = {r.metric: r.value for r in spark.read.schema("app string, metric string, value double").json(done["report"]).collect()}
    assert report["logloss"] is None and 0.5 < report["auc"] <= 1 and 0 < report["precision"] <= 1
    done = flows.run_model(spark, inputs, home, "lr", evaluate=False, pca_k=4)
    n = fx.test_pair.count()
    first = [r.value for r in S.read_lines_in_order(spark, done["submission"]).orderBy("row_no").collect()]
    assert len(first) == n + 1 and first[0] == "y_pre" and all(0 <= float(v) <= 1 for v in first[1:])
    again = flows.run_model(spark, inputs, f"{tmp_out}/again", "lr", evaluate=False, scorer_path=done["scorer"])
    second = [r.value for r in S.read_lines_in_order(spark, again["submission"]).orderBy("row_no").collect()]
    assert second == first and "scorer" not in again


def test_pair_in_two_files_is_scored_once(spark, tmp_out):
    import os

    from pairlens.operators import evaluate as EV
    from test_streaming import write_lines

    qf = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [9])], "qid bigint, words array<bigint>")
    src, sink, ckpt = f"{tmp_out}/in", f"{tmp_out}/out", f"{tmp_out}/ckpt"

    def run():
        score_stream(spark, src, qf, ["jaccard_set"], sink, ckpt, scorer=EV.rule_scorer, dedupe_within="1 day",
                     by_batch=True).awaitTermination()
        return sorted((r.q1, r.q2) for r in S.read_predictions(spark, f"{sink}/batch-*").collect())

    write_lines(src, "a.csv", ["q1,q2", "Q1,Q2", "Q1,Q3", "Q1,Q2"])
    assert run() == [(1, 2), (1, 3)]
    write_lines(src, "b.csv", ["q1,q2", "Q1,Q2", "Q2,Q3", "Q2,Q1"])
    assert run() == [(1, 2), (1, 3), (2, 1), (2, 3)]  # pairs are ordered; state outlived the restart
    # A replay of the last batches writes the same folders again.
    before = sorted(os.listdir(sink))
    for name in os.listdir(f"{ckpt}/commits"):
        if name.strip(".").split(".")[0] == "1":
            os.remove(f"{ckpt}/commits/{name}")
    assert run() == [(1, 2), (1, 3), (2, 1), (2, 3)] and sorted(os.listdir(sink))[:len(before)] == before
