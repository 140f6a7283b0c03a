"""Components of the question graph and splits that keep them whole."""
import random

import pytest
from pyspark.sql import functions as F

from pairlens.operators import components as C


def by_hand(pairs):
    label = {}

    def find(i):
        while label.setdefault(i, i) != i:
            i = label[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {i: find(i) for i in list(label)}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "two chains", "none"])
def test_components(spark, shape):
    rnd = random.Random(2)
    pairs = {"random": [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)],
             "chain": [(i, i + 1) for i in range(200)], "star": [(7, i) for i in range(300)],
             "two chains": [(2 * i, 2 * i + 2) for i in range(100)] + [(2 * i + 3, 2 * i + 1) for i in range(100)], "none": []}[shape]
    pairs = pairs + [(5, 5), (None, 9), (900, None)] if shape == "random" else pairs
    df = spark.createDataFrame(pairs, "q1 bigint, q2 bigint")
    got = {r.qid: r.component for r in C.components(df).collect()}
    expected = by_hand([p for p in pairs if None not in p])
    expected |= {i: i for p in pairs for i in p if i is not None and i not in expected}
    assert got == expected


def pairs_of(spark):
    rnd = random.Random(6)
    rows = [(c * 10 + rnd.randrange(10), c * 10 + rnd.randrange(10), 1, c) for c in range(80) for _ in range(12)]
    rows += [(rnd.randrange(800), rnd.randrange(800), 0, -1) for _ in range(400)]  # joins nearly all into one component
    return spark.createDataFrame(rows, "q1 bigint, q2 bigint, label int, note int").dropDuplicates(["q1", "q2"])


def test_no_question_on_both_sides(spark):
    pairs = pairs_of(spark)
    for add, column, cross in ((C.with_component_split, "part", "between"), (C.with_component_fold, "fold", -1)):
        for linked_by in ("all", "positive"):
            out = add(pairs, linked_by=linked_by)
            assert out.columns == [*pairs.columns, "component", column]
            rows = out.collect()
            assert len(rows) == pairs.count()
            sides = {}
            for r in rows:
                if r[column] != cross:
                    for q in (r.q1, r.q2):
                        sides.setdefault(q, set()).add(r[column])
            assert all(len(s) == 1 for s in sides.values())
            if linked_by == "all":
                assert not any(r[column] == cross for r in rows)
            else:
                assert all(r[column] != cross for r in rows if r.label == 1)
                assert len({next(iter(s)) for s in sides.values()}) == (2 if column == "part" else 3)


def test_split_by_component_keeps_its_share(spark):
    rows = [(2 * i, 2 * i + 1, 1) for i in range(3000)]
    out = C.with_component_split(spark.createDataFrame(rows, "q1 bigint, q2 bigint, label int"), 80)
    share = out.agg(F.avg((F.col("part") == "train").cast("double"))).first()[0]
    assert 0.77 < share < 0.83
    with pytest.raises(ValueError, match="linked_by"):
        C.with_component_split(out, linked_by="some")


def test_exact_auc_selects(spark):
    from pairlens.operators.evaluate import ExactAuc, auc
    from pairlens.plans.models import cross_validator

    rnd = random.Random(9)
    rows = [(i % 3, int(y), rnd.choice([0.1, 0.4, 0.4, 0.8]) + 0.2 * y) for i, y in enumerate(rnd.random() < 0.4 for _ in range(300))]
    df = spark.createDataFrame(rows, "fold int, label int, x double")
    pos, neg = [r[2] for r in rows if r[1]], [r[2] for r in rows if not r[1]]
    exact = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert ExactAuc(scoreCol="x").evaluate(df) == pytest.approx(exact, abs=1e-12)
    assert ExactAuc(scoreCol="x").evaluate(df.where("label = 1")) == 0.5 and ExactAuc().isLargerBetter()
    for model in ("lr", "gbt", "svm", "mlp"):
        cv = cross_validator(model, ["x"]).setCollectSubModels(True).fit(df)
        own = []
        for k, models in enumerate(cv.subModels):
            held = df.where(F.col("fold") == k)
            own.append([auc(m.transform(held).withColumn("s", _second("rawPrediction")), "s").first()["auc"] for m in models])
        assert list(cv.avgMetrics) == pytest.approx([sum(c) / 3 for c in zip(*own)], abs=1e-12)


def _second(col):
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(col)[1]
