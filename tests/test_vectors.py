import pytest
from pyspark.sql import functions as F

from pairlens.operators.vectors import question_features, reduce_word_vectors


@pytest.fixture
def tables(spark):
    question = spark.createDataFrame(
        [(1, [10, 11, 10]), (2, [10, 99]), (3, [98]), (4, [])],
        "qid bigint, word_ids array<bigint>")
    word_vec = spark.createDataFrame(
        [(10, [1.0, 2.0]), (11, [0.5, -1.0])], "wid bigint, features array<double>")
    return question, word_vec


def by_qid(df):
    return {r.qid: r for r in df.collect()}


def test_sum_and_missing_zero(spark, tables):
    rows = by_qid(question_features(*tables))
    assert rows[1].features == [2.5, 3.0]          # 2 * [1,2] + [0.5,-1]
    assert rows[1].n_words == 3 and rows[1].n_missing == 0
    assert list(rows[1].words) == [10, 11]
    assert sorted(rows[1].tags) == ["10:1", "10:2", "11:1"]
    seq = by_qid(question_features(*tables, sequence=True))
    assert list(seq[1].word_ids) == [10, 11, 10]    # order kept
    assert rows[2].features == [1.0, 2.0] and rows[2].n_missing == 1
    assert rows[3].features == [0.0, 0.0]           # no word with a vector
    assert rows[4].features == [0.0, 0.0] and rows[4].n_words == 0 and rows[4].tags == []


def test_truncate_mode_matches_reference(spark, tables):
    rows = by_qid(question_features(*tables, missing="truncate"))
    assert rows[1].features == [2.5, 3.0]
    assert rows[2].features == [1.0]                # one missing word truncates to length 1
    assert rows[3].features == [0.0]


def test_identical_questions_identical_vectors(spark):
    q = spark.createDataFrame([(i, [3, 1, 2, 1, 3, 3]) for i in range(40)] +
                              [(100 + i, [1, 3, 3, 2, 3, 1]) for i in range(40)],
                              "qid bigint, word_ids array<bigint>")
    wv = spark.createDataFrame([(w, [0.1 * w, 1 / 3, 1e-7 * w]) for w in (1, 2, 3)],
                               "wid bigint, features array<double>")
    vecs = {tuple(r.features) for r in question_features(q, wv).collect()}
    assert len(vecs) == 1


def test_pca_then_sum_equals_sum_then_pca(spark):
    from pyspark.ml.feature import PCAModel  # noqa: F401
    wv = spark.createDataFrame([(i, [float((i * 7) % 5), float(i % 3), float((i * i) % 11), 1.0])
                                for i in range(30)], "wid bigint, features array<double>")
    q = spark.createDataFrame([(1, [1, 2, 3, 3]), (2, [5, 7, 11])], "qid bigint, word_ids array<bigint>")
    reduced, model = reduce_word_vectors(wv, 2)
    first = by_qid(question_features(q, reduced))
    summed = question_features(q, wv).select("qid", F.col("features"))
    from pyspark.ml.functions import array_to_vector, vector_to_array
    model.setInputCol("v").setOutputCol("p")
    after = by_qid(model.transform(summed.select("qid", array_to_vector("features").alias("v")))
                   .select("qid", vector_to_array("p").alias("features")))
    for qid in (1, 2):
        assert first[qid].features == pytest.approx(after[qid].features, abs=1e-9)


def test_word_sets_are_taken_row_by_row(spark):
    q = spark.createDataFrame([(1, [3, 1, 3, None, 2]), (2, []), (3, None), (None, [5, 5])], "qid bigint, word_ids array<bigint>")
    vectors = spark.createDataFrame([(1, [1.0])], "wid bigint, features array<double>")
    sets = question_features(q.unionByName(q.where("qid = 1").selectExpr("qid", "array(9L) as word_ids")), vectors, columns=["words"])
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "collect_list" not in plan
    assert {r.qid: r.words for r in sets.collect()} == {1: [1, 2, 3], 2: [], 3: [], None: [5]}
    both = {r.qid: r.words for r in question_features(q, vectors, columns=["words", "tags"]).collect()}
    assert both == {r.qid: r.words for r in question_features(q, vectors, columns=["words"]).collect()}
