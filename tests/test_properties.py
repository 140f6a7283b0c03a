"""Metric properties on many random rows, computed in one Spark job and
compared with plain Python formulas."""
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairlens.functions import metrics as M


def occ_tags(c):
    return M.occurrence_tags(c, F.transform(c, lambda x, i: F.size(F.filter(F.slice(c, 1, i + 1),
                                                                             lambda y: y == x))))


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(11)
    data = []
    for _ in range(300):
        k = rnd.randint(1, 8)
        a = [rnd.uniform(-2, 2) for _ in range(k)]
        b = [rnd.uniform(-2, 2) for _ in range(k)]
        wa = [rnd.randint(0, 6) for _ in range(rnd.randint(0, 12))]
        wb = [rnd.randint(0, 6) for _ in range(rnd.randint(0, 12))]
        data.append((a, b, wa, wb))
    df = spark.createDataFrame(data, "a array<double>, b array<double>, wa array<bigint>, wb array<bigint>")
    df = df.select("*", occ_tags(F.col("wa")).alias("ta"), occ_tags(F.col("wb")).alias("tb"))
    out = df.select(
        "a", "b", "wa", "wb",
        M.cosine("a", "b").alias("cos_ab"), M.cosine("b", "a").alias("cos_ba"),
        M.manhattan("a", "b").alias("man_ab"), M.manhattan("b", "a").alias("man_ba"),
        M.chebyshev("a", "b").alias("che"), M.euclidean_l2("a", "b").alias("l2"),
        M.jaccard("wa", "wb", "ta", "tb").alias("jac_ab"), M.jaccard("wb", "wa", "tb", "ta").alias("jac_ba"),
        M.jaccard_set("wa", "wb").alias("js"))
    return out.collect()


def test_vector_metric_properties(rows):
    for r in rows:
        a, b = r.a, r.b
        dot = sum(x * y for x, y in zip(a, b))
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(y * y for y in b))
        assert r.cos_ab == pytest.approx(dot / (na * nb), abs=1e-12)
        assert -1 - 1e-12 <= r.cos_ab <= 1 + 1e-12 and r.cos_ab == pytest.approx(r.cos_ba)
        assert r.man_ab == pytest.approx(sum(abs(x - y) for x, y in zip(a, b))) and r.man_ab == pytest.approx(r.man_ba)
        assert r.che == pytest.approx(max(abs(x - y) for x, y in zip(a, b)))
        assert r.che <= r.l2 + 1e-12 <= r.man_ab + 2e-12


def test_sequence_metric_properties(rows):
    for r in rows:
        wa, wb = list(r.wa), list(r.wb)
        union = len(set(wa) | set(wb))
        if union == 0:
            assert math.isnan(r.jac_ab) and math.isnan(r.js)
            continue
        multi = sum((Counter(wa) & Counter(wb)).values())
        assert r.jac_ab == pytest.approx(multi / union) and r.jac_ab == pytest.approx(r.jac_ba)
        assert r.js == pytest.approx(len(set(wa) & set(wb)) / union) and 0 <= r.js <= 1
