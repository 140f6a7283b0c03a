import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlens.functions import metrics as M
from pairlens.functions.edit_distance import levenshtein_dp, levenshtein_ids


def row(spark, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols.keys()))


def one(df, expr):
    return df.select(expr.alias("x")).first()["x"]


def test_vector_metrics(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 0.0, 3.5])], "a array<double>, b array<double>")
    assert one(df, M.dot("a", "b")) == pytest.approx(2.0 + 0 + 10.5)
    assert one(df, M.manhattan("a", "b")) == pytest.approx(1 + 2 + 0.5)
    assert one(df, M.chebyshev("a", "b")) == pytest.approx(2.0)
    ssd = 1 + 4 + 0.25
    assert one(df, M.euclidean("a", "b")) == pytest.approx(ssd ** -2)
    assert one(df, M.euclidean_l2("a", "b")) == pytest.approx(math.sqrt(ssd))
    cos = 12.5 / (math.sqrt(14) * math.sqrt(4 + 12.25))
    assert one(df, M.cosine("a", "b")) == pytest.approx(cos)


def test_reference_corner_cases(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0], [], [])],
                               "z array<double>, v array<double>, e1 array<double>, e2 array<double>")
    assert math.isnan(one(df, M.cosine("z", "v")))          # zero vector: 0/0
    assert one(df, M.euclidean("v", "v")) == float("inf")   # identical: ssd ** -2
    assert one(df, M.chebyshev("e1", "e2")) is None           # empty vectors


def jaccards(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
    occ = lambda c: F.transform(c, lambda x, i: F.size(F.filter(F.slice(c, 1, i + 1), lambda y: y == x)))
    tagged = df.select("a", "b", M.occurrence_tags("a", occ(F.col("a"))).alias("ta"),
                       M.occurrence_tags("b", occ(F.col("b"))).alias("tb"))
    r = tagged.select(M.jaccard("a", "b", "ta", "tb").alias("j"), M.jaccard_set("a", "b").alias("s")).first()
    return r["j"], r["s"]


def test_jaccard_multiset_over_set_union(spark):
    j, s = jaccards(spark, [1, 1, 2], [1, 1, 2])
    assert j == pytest.approx(1.5) and s == pytest.approx(1.0)      # not bounded by 1
    j, s = jaccards(spark, [1, 1, 2], [1, 1, 3])
    assert j == pytest.approx(2 / 3) and s == pytest.approx(1 / 3)
    j, s = jaccards(spark, [], [])
    assert math.isnan(j) and math.isnan(s)


def test_edit_distance_bitparallel_equals_dp():
    rnd = random.Random(7)
    for _ in range(2000):
        a = [rnd.randint(0, 5) for _ in range(rnd.randint(0, 90))]
        b = [rnd.randint(0, 5) for _ in range(rnd.randint(0, 90))]
        assert levenshtein_ids(a, b) == levenshtein_dp(a, b)
    assert levenshtein_ids([1, 2, 3], [2, 3, 4, 5]) == 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=70), st.lists(st.integers(0, 4), max_size=70))
def test_edit_distance_properties(a, b):
    d = levenshtein_ids(a, b)
    assert d == levenshtein_ids(b, a)
    assert abs(len(a) - len(b)) <= d <= max(len(a), len(b))


def test_edit_distance_udf_on_whole_fixture_texts(spark):
    """Brute-force check of the registered edit-distance query at sf0.001."""
    import __spark_entry__ as E
    from conftest import SMALL
    from pairlens.sources.testdata import prepare
    got = {(r.q1, r.q2): r.edit_distance for r in E.queries()["pair_edit_distance"](spark, SMALL).collect()}
    q = {r.qid: list(r.word_ids) for r in prepare(spark, SMALL).question().collect()}
    assert got
    for (a, b), d in got.items():
        assert d == levenshtein_dp(q[a], q[b])


def test_edit_distance_without_python_workers(spark):
    import random

    from pairlens.functions.edit_distance import edit_distance, edit_distance_jvm, levenshtein_dp

    rnd = random.Random(1)
    rows = []
    for i in range(150):
        k, n, m = rnd.choice([2, 5, 50]), rnd.choice([0, 1, 5, 61, 62, 63, 124, 125]), rnd.choice([0, 1, 7, 62, 63, 186])
        a, b = [rnd.randrange(k) for _ in range(n)], [rnd.randrange(k) for _ in range(m)]
        if rnd.random() < 0.4:
            b = list(a)
            for _ in range(rnd.randint(0, 9)):
                if b and rnd.random() < 0.5:
                    del b[rnd.randrange(len(b))]
                else:
                    b.insert(rnd.randrange(len(b) + 1), rnd.randrange(k))
        rows.append((i, a, b))
    rows += [(1000, None, [1]), (1001, [1], None)]
    df = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>")
    jvm = df.select("i", edit_distance_jvm("a", "b").alias("d"))
    assert "ArrowEvalPython" not in jvm._jdf.queryExecution().executedPlan().toString()
    expected = {i: float(levenshtein_dp(a, b)) if a is not None and b is not None else None for i, a, b in rows}
    assert {r.i: r.d for r in jvm.collect()} == expected
    assert {r.i: r.d for r in df.select("i", edit_distance("a", "b").alias("d")).collect()} == expected
