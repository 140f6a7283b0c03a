"""Sketches per file and features per bucket: an update touches what changed and nothing else."""
import os
import random

import pytest
from pyspark.sql import functions as F

from pairlens.operators import incremental as I
from pairlens.operators.vectors import question_features
from pairlens.sources import sketches as SK


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def files_of(path):
    return {d: sorted(f for f in os.listdir(f"{path}/features/{d}") if f.endswith(".parquet"))
            for d in os.listdir(f"{path}/features") if d.startswith("bucket=")}


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = random.Random(1)
    return spark.createDataFrame([(w, [rnd.random() for _ in range(3)]) for w in range(30)], "wid bigint, features array<double>")


def questions(spark, change=()):
    rnd = random.Random(2)
    rows = {i: [rnd.randrange(35) for _ in range(rnd.randint(0, 9))] for i in range(200)}
    rows.update(change)
    return spark.createDataFrame([(i, w) for i, w in rows.items() if w is not None], "qid bigint, word_ids array<bigint>")


def test_only_touched_buckets_are_written(spark, vectors, tmp_out):
    path = f"{tmp_out}/features"
    assert I.update_features(questions(spark), vectors, path, buckets=16)["computed"] == 200
    before = files_of(path)
    assert I.update_features(questions(spark), vectors, path, buckets=16) == {"computed": 0, "removed": 0, "buckets": 0}
    assert files_of(path) == before
    # A changed, an appended, a removed and a reordered question (another content).
    change = {5: [1, 2, 3], 1000: [4, 4, 34], 17: None, 8: [29, 1]}
    now = questions(spark, change)
    done = I.update_features(now, vectors, path, buckets=16)
    assert (done["computed"], done["removed"]) == (3, 1) and 1 <= done["buckets"] <= 4
    after = files_of(path)
    buckets = {f"bucket={r[0]}" for r in spark.createDataFrame([(i,) for i in change], "qid bigint").select(
        F.pmod(F.xxhash64("qid"), F.lit(16))).collect()}
    assert {d for d in after if after[d] != before.get(d)} == buckets and len(buckets) == done["buckets"]
    assert rows_of(I.read_features(spark, path)) == rows_of(question_features(now, vectors).select(*I.read_features(spark, path).columns))
    # The removed question comes back.
    again = {**change, 17: [3]}
    assert I.update_features(questions(spark, again), vectors, path, buckets=16)["computed"] == 1
    assert rows_of(I.read_features(spark, path)) == rows_of(
        question_features(questions(spark, again), vectors).select(*I.read_features(spark, path).columns))


def test_other_vectors_or_settings_compute_all(spark, vectors, tmp_out):
    path = f"{tmp_out}/features"
    columns = ["features", "n_missing"]
    I.update_features(questions(spark), vectors, path, buckets=4, columns=columns)
    for vecs, missing in ((vectors.where("wid < 20"), "zero"), (vectors.where("wid < 20"), "truncate")):
        assert I.update_features(questions(spark), vecs, path, buckets=4, missing=missing, columns=columns)["computed"] == 200
        assert rows_of(I.read_features(spark, path)) == rows_of(
            question_features(questions(spark), vecs, missing=missing, columns=columns))
    assert I.update_features(questions(spark).limit(0), vecs, path, buckets=4, missing="truncate", columns=columns)["removed"] == 200
    assert I.read_features(spark, path).count() == 0


def test_sketches_merge_and_read_new_files_only(spark, tmp_out):
    source, path = f"{tmp_out}/source", f"{tmp_out}/sketches"
    rnd = random.Random(3)

    def add(n, lo, files):
        rows = [(lo + rnd.randrange(n), list(range(rnd.randrange(1000)))) for _ in range(2 * n)]
        spark.createDataFrame(rows, "k bigint, l array<bigint>").repartition(files).write.mode("append").parquet(source)
        return rows

    rows = add(2000, 0, 3)
    read = lambda: spark.read.schema("k bigint, l array<bigint>").parquet(source)
    assert SK.update_sketches(spark, path, "s", read(), ["k"], "l") == 3
    assert SK.update_sketches(spark, path, "s", read(), ["k"], "l") == 0
    rows += add(1500, 1000, 2)
    assert SK.update_sketches(spark, path, "s", read(), ["k"], "l") == 2
    assert SK.update_sketches(spark, path, "t", read(), ["k", "l"]) == 5
    got = {r.source: r for r in SK.merged_profile(SK.read_sketches(spark, path)).collect()}
    s, lengths = got["s"], sorted(len(x) for _, x in rows)
    assert (s.n_files, s.n_rows, s.min_len, s.max_len) == (5, len(rows), lengths[0], lengths[-1])
    exact = len({k for k, _ in rows})
    assert abs(s.n_keys - exact) <= SK.KEY_BOUND * exact
    for q in SK.QUANTILES:
        value = s[f"len_q{round(100 * q)}"]
        assert sum(x < value for x in lengths) / len(lengths) - SK.RANK_BOUND <= q <= sum(x <= value for x in lengths) / len(lengths) + SK.RANK_BOUND
    assert got["t"].len_q50 is None and got["t"].min_len is None and got["t"].n_rows == len(rows)
    assert SK.merged_profile(SK.read_sketches(spark, f"{tmp_out}/none")).collect() == []
