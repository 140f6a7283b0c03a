"""Vector sums do not depend on order or partitioning, and no plan collects vectors."""
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pairlens.operators.vectors import fixed_point, question_features, vector_facts


@pytest.fixture(params=["broadcast", "shuffle"])
def join_mode(spark, request):
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    if request.param == "shuffle":
        for k in keys:
            spark.conf.set(k, "-1")
    yield request.param
    for k in keys:
        spark.conf.unset(k)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sums_are_exact_in_any_order(spark, join_mode):
    rnd = random.Random(7)
    words = {w: [rnd.uniform(-1, 1) * 10 ** rnd.randint(-2, 2) for _ in range(3)] for w in range(400)}
    question = {i: [rnd.randrange(420) for _ in range(300)] for i in range(20)}
    question |= {100 + i: rnd.sample(question[i], 300) for i in range(20)}  # the same words in another order
    vectors = spark.createDataFrame(list(words.items()), "wid bigint, features array<double>")
    results = set()
    for parts in (1, 3, 7):
        q = spark.createDataFrame(list(question.items()), "qid bigint, word_ids array<bigint>").repartition(parts)
        got = {r.qid: tuple(r.features) for r in question_features(q, vectors, partitions=parts).collect()}
        assert all(got[i] == got[100 + i] for i in range(20))
        results.add(tuple(sorted(got.items())))
    assert len(results) == 1
    largest = max(abs(x) for v in words.values() for x in v)
    for i, value in dict(next(iter(results))).items():
        for d in range(3):
            exact = sum((Fraction(words[w][d]) for w in question[i] if w in words), Fraction(0))
            assert abs(Fraction(value[d]) - exact) <= Fraction(largest) * Fraction(300, 2**58) + abs(exact) * Fraction(1, 2**52)


def test_no_list_of_vectors_in_the_plan(spark, join_mode):
    vectors = spark.createDataFrame([(w, [1.0, 2.0]) for w in range(9)], "wid bigint, features array<double>")
    q = spark.createDataFrame([(1, [1, 2]), (2, [3])], "qid bigint, word_ids array<bigint>")
    plan = plan_of(question_features(q, vectors, columns=["features", "norm", "n_missing"]))
    assert "collect_list" not in plan and "collect_set" not in plan
    assert ("BroadcastHashJoin" in plan) == (join_mode == "broadcast")
    # With the word lists the collected rows hold ids and counts only.
    plan = plan_of(question_features(q, vectors))
    lines = [line for line in plan.splitlines() if "collect_list" in line]
    assert lines and not any("high" in line or "features" in line for line in lines)


def test_vectors_go_to_groups_and_no_partial_sums_are_shuffled(spark, join_mode, monkeypatch):
    from pairlens.operators import vectors as V

    rnd = random.Random(5)
    words = {w: [float(rnd.randint(-9, 9)) for _ in range(2)] for w in range(60)}
    question = {i: [rnd.choice([*range(70), None]) for _ in range(rnd.randrange(40))] for i in range(300)} | {300: None, None: [1, 1, 65]}
    word_vec = spark.createDataFrame(list(words.items()), "wid bigint, features array<double>")
    q = spark.createDataFrame(list(question.items()), "qid bigint, word_ids array<bigint>")
    for limit in (50, V.GROUP_WORDS):  # many groups, and as few as there are partitions
        for name in ("GROUP_WORDS", "ADD_WORDS", "COUNT_WORDS"):
            monkeypatch.setattr(V, name, min(limit, getattr(V, name)))
        df = question_features(q.unionByName(q), word_vec, columns=["features", "n_words", "n_missing"])
        assert "_high" not in plan_of(df) and "partial_sum" not in plan_of(df)
        got = {r.qid: (list(r.features), r.n_words, r.n_missing) for r in df.collect()}
        assert got == {i: ([float(sum(words[w][d] for w in ws if w in words)) for d in (0, 1)], len(ws), sum(w not in words for w in ws))
                       for i, ws in ((i, [w for w in ws or [] if w is not None]) for i, ws in question.items())}
        monkeypatch.undo()


def test_identical_texts_give_infinity(spark, join_mode):
    from pairlens.operators.pairs import pair_features

    vectors = spark.createDataFrame([(w, [0.1 * w, 1 / 3, 1e-7 * w]) for w in range(50)], "wid bigint, features array<double>")
    rnd = random.Random(3)
    text = [rnd.randrange(50) for _ in range(500)]
    q = spark.createDataFrame([(1, text), (2, text[::-1])], "qid bigint, word_ids array<bigint>")
    row = pair_features(spark.createDataFrame([(1, 2)], "q1 bigint, q2 bigint"), question_features(q, vectors), "euclidean").first()
    assert row.euclidean == float("inf")


def test_facts_reject_what_cannot_be_summed(spark):
    def frame(*vectors):
        return spark.createDataFrame(list(enumerate(vectors)), "wid bigint, features array<double>")

    for bad in ([float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], None):
        with pytest.raises(ValueError, match="1 word vectors"):
            vector_facts(frame([1.0, 2.0], bad))
    with pytest.raises(ValueError, match="1 to 2"):
        vector_facts(frame([1.0, 2.0], [1.0]))
    with pytest.raises(ValueError, match="empty"):
        vector_facts(frame())
    facts = vector_facts(frame([0.0, -8.0], [3.0, 1e-300]))
    assert (facts.dim, facts.largest, facts.rows, facts.fixed_bytes) == (2, 8.0, 2, 64)
    zero = frame([0.0], [0.0])
    assert fixed_point(zero, vector_facts(zero)).where(F.col("high")[0] != 0).count() == 0
    tiny = frame([5e-324], [0.0])
    assert vector_facts(tiny).exponent >= -1000 and fixed_point(tiny, vector_facts(tiny)).count() == 2
