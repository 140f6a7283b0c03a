"""Word ids and word vectors go to groups of rows that lie together; tokens are not shuffled."""
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlens.operators import pairs as P
from pairlens.operators import vectors as V
from pairlens.sources import testdata as T


def texts(spark):
    rows = [(i, f"w{i % 7} Shared shared w{i} {'x ' * (i % 4)}" if i % 11 else [None, "", "12 34"][i % 3]) for i in range(300)]
    return spark.createDataFrame([*rows, (None, "no id")], "doc_id bigint, text string")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_questions_by_groups(spark, monkeypatch):
    documents = texts(spark)
    said = {r.doc_id: r.words or [] for r in T.doc_words(documents).collect()}
    order = sorted((-n, w) for w, n in Counter(w for ws in said.values() for w in ws).items())
    rank = {w: i for i, (_, w) in enumerate(order)}
    for limit in (50, V.GROUP_WORDS):
        monkeypatch.setattr(V, "GROUP_WORDS", limit)
        words = T.doc_words(T.documents_by_id(documents))
        grouped = T.group_words(words)
        vocab = T.vocabulary(grouped)
        assert {r.w: (r.n, r.wid) for r in vocab.collect()} == {w: (-n, rank[w]) for n, w in order}
        got = T.questions(words, vocab, grouped)
        assert {r.qid: r.word_ids for r in got.collect()} == {i: [rank[w] for w in ws] for i, ws in said.items()}
        assert "posexplode" not in plan_of(got) and "collect_list" not in plan_of(got)
        # A word that the vocabulary lacks is left out.
        fewer = T.questions(words, vocab.where("w <> 'shared'"), grouped)
        assert {r.qid: r.word_ids for r in fewer.collect()} == {i: [rank[w] for w in ws if w != "shared"] for i, ws in said.items()}
    none = T.doc_words(documents.where("text is null or text = ''"))
    assert {tuple(r.word_ids) for r in T.questions(none, vocab, T.group_words(none)).collect()} == {()}


def test_a_partition_holds_whole_groups(spark):
    n = V.shuffle_partitions(spark.range(1))
    laid = spark.range(2000).repartition(n, "id").select(F.spark_partition_id().alias("p"), V.group_of("id", 3 * n).alias("g"))
    assert laid.groupBy("g").agg(F.count_distinct("p").alias("n")).where("n > 1").count() == 0
    assert V.group_count(laid, 0) == n and V.group_count(laid, V.GROUP_WORDS * n + 1) == 2 * n


def test_vectors_are_sent_as_32_bits_only_where_these_hold_them(spark):
    single = spark.createDataFrame([(1, [0.5, -3.0]), (2, [2.0**-40, 1.0])], "wid bigint, features array<double>")
    double = spark.createDataFrame([(1, [0.1, -3.0])], "wid bigint, features array<double>")
    q = spark.createDataFrame([(1, [1, 1, 2])], "qid bigint, word_ids array<bigint>")
    assert V.vector_facts(single).single and not V.vector_facts(double).single
    assert V.question_features(q, single, columns=["features"]).first().features == [1.0 + 2.0**-40, -5.0]
    assert V.question_features(q, double, columns=["features"]).first().features == [0.2, -6.0]


def test_words_of_a_group_are_asked_for_once_and_not_as_rows_of_all_questions(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(50)], "wid bigint, features array<double>")
    q = spark.createDataFrame([(i, [i % 50, i % 7, i % 7, None]) for i in range(400)] + [(None, [3]), (400, None)],
                              "qid bigint, word_ids array<bigint>")
    plan = plan_of(V.question_features(q, vectors, columns=["features"]))
    assert "Generate" not in plan and "HashAggregate(keys=[g#" not in plan
    for limit in (5, V.GROUP_WORDS):  # what is held goes out early, or once
        monkeypatch.setattr(V, "GROUP_WORDS", limit)
        got = {r.qid: r.features for r in V.question_features(q, vectors, columns=["features"]).collect()}
        assert got == {i: [float(i % 50 + 2 * (i % 7))] for i in range(400)} | {None: [3.0], 400: [0.0]}


def test_repeats_are_told_row_by_row(spark):
    big = 1 << 50
    rows = [(1, [3, 1, 3, 3, None, big, big, -2, -2]), (2, [3, 3, big, big, big, -2]), (3, []), (4, None), (None, [5, 5])]
    q = spark.createDataFrame(rows, "qid bigint, word_ids array<bigint>")
    vectors = spark.createDataFrame([(1, [1.0])], "wid bigint, features array<double>")
    asked = V.question_features(q, vectors, columns=P.question_columns("jaccard"))
    assert "Generate" not in plan_of(asked) and "collect_list" not in plan_of(asked)
    got = {r.qid: (r.words, r.repeats, r.odd_repeats) for r in asked.collect()}
    assert got[1] == ([-2, 1, 3, big], [3 << 20 | 2, 3 << 20 | 3], ["-2:2", f"{big}:2"])
    assert got[3] == got[4] == ([], [], []) and got[None] == ([5], [5 << 20 | 2], [])
    # The same value as by tags, NaN of two empty lists and unknown questions included.
    pairs = spark.createDataFrame([(a, b) for a in (1, 2, 3, 4, 9) for b in (1, 2, 3, 9)], "q1 bigint, q2 bigint")
    tags = V.question_features(q, vectors, columns=["words", "tags"])
    values = [{(r.q1, r.q2): str(r.jaccard) for r in P.pair_features(pairs, qf, "jaccard", how="left").collect()} for qf in (asked, tags)]
    assert values[0] == values[1] and values[0][1, 2] == str(5 / 4) and values[0][3, 3] == "nan" and values[0][1, 9] == "None"


def test_a_bound_scorer_reads_features_in_place(spark):
    from pairlens.plans.scoring import new_scorer

    for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(k, "-1")
    try:
        q = spark.createDataFrame([(i, [i % 5, i % 3]) for i in range(60)], "qid bigint, word_ids array<bigint>")
        vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "wid bigint, features array<double>")
        pairs = spark.createDataFrame([(i, (i * 7) % 61) for i in range(62)], "q1 bigint, q2 bigint")
        scorer = new_scorer(["cosine", "jaccard"], "lr").bind(q, vectors)
        found = scorer.pair_features(pairs)
        assert plan_of(found).count("Exchange hashpartitioning") == 2  # the pairs, by q1 and by q2
        plain = scorer.bind_features(scorer.question_features).pair_features(pairs)
        rows = [sorted(map(str, df.collect())) for df in (found, plain)]
        assert rows[0] == rows[1] and len(rows[0]) == 62
    finally:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)


def test_counts_say_what_repeats_say(spark):
    big = 1 << 50
    rows = [(1, [3, 1, 3, 3, None, big, big, -2, -2]), (2, [3, 3, big, big, big, -2]), (3, []), (4, None), (5, [7, 7, 7, 1, 1, 3])]
    q = spark.createDataFrame(rows, "qid bigint, word_ids array<bigint>")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (3, [0.5, 0.25])], "wid bigint, features array<double>")
    pairs = spark.createDataFrame([(a, b) for a in (1, 2, 3, 4, 5, 9) for b in (1, 2, 3, 5, 9)], "q1 bigint, q2 bigint")
    names = ["cosine", "jaccard"]
    kept = P.kept_columns(names)
    assert "counts" in kept and "repeats" not in kept
    found = [V.question_features(q, vectors, columns=[*c]) for c in (kept, P.question_columns(names), P.kept_columns(["jaccard"]))]
    assert dict(found[0].dtypes)["words"] == "array<bigint>"
    small = V.question_features(q.where("qid > 2"), vectors, columns=kept)  # ids that 32 bits hold
    assert dict(small.dtypes)["words"] == "array<int>" and {r.qid: (r.words, r.counts) for r in small.collect()}[5] == ([1, 3, 7], [2, 1, 3])
    assert [str(r.jaccard) for r in P.pair_features(pairs.where("q1 = 5 and q2 = 5"), small, "jaccard").collect()] == ["2.0"]
    assert {r.qid: (r.words, r.counts) for r in found[0].collect()} == {r.qid: (r.words, r.counts) for r in found[2].collect()}
    assert "Join" not in plan_of(found[0]).replace("BroadcastHashJoin", "").replace("SortMergeJoin", "", 1)  # words come with the sums
    values = [{(r.q1, r.q2): str(r.jaccard) for r in P.pair_features(pairs, qf, "jaccard", how="left").collect()} for qf in found]
    assert values[0] == values[1] == values[2] and values[0][1, 2] == str(5 / 4) and values[0][3, 3] == "nan" and values[0][1, 9] == "None"


@pytest.mark.parametrize("words", [40, 1500, 1 << 24])
def test_groups_are_laid_out_without_another_shuffle(spark, monkeypatch, words):
    from pairlens.operators.colocated import lay_out

    monkeypatch.setattr(V, "SUM_WORDS", words)  # several groups for each bucket, several buckets for each group
    q = spark.createDataFrame([(i, [i % 5, i % 3, 1]) for i in range(500)], "qid bigint, word_ids array<bigint>")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "wid bigint, features array<double>")
    columns = P.kept_columns(["cosine", "jaccard"])
    assert V.in_groups(columns) and not V.in_groups(columns, sequence=True) and not V.in_groups(["qid", "features", "tags"])
    assert not V.in_groups(["qid", "words", "counts"]) and not V.in_groups(["qid", "words", "features"])
    features = V.question_features(q, vectors, columns=columns)
    laid = lay_out(features, "qid", "groups", in_groups=True)
    n = V.shuffle_partitions(q)
    files = spark.read.parquet(laid.path).select(F.regexp_extract(F.input_file_name(), r"_(\d+)\.c", 1).cast("int").alias("file"),
                                                 V.group_of("qid", n).alias("bucket"))
    assert files.where("file <> bucket").count() == 0 and files.count() == 500
    ids = laid.in_place(spark).groupBy("qid").count()
    assert "Exchange" not in plan_of(ids) and ids.where("count = 1").count() == 500
    assert sorted(map(str, laid.plain(spark).collect())) == sorted(map(str, features.collect()))


def test_documents_go_to_their_group_packed(spark):
    words = T.doc_words(texts(spark))
    grouped = T.group_words(words)
    coded = [r for r in plan_of(T.questions(words, T.vocabulary(grouped), grouped)).splitlines() if "_coded" in r]
    assert coded and all("array<" not in r and "names" not in r for r in coded)
    rows = pa.record_batch({"qid": [1, 2], "apart": [[1], []]})
    assert V.unpacked(V.packed(rows)[0].as_buffer()) == pa.Table.from_batches([rows])
    assert [V.shrunk(np.array(x, int)).dtype.itemsize for x in ([1, -128], [128], [1 << 20], [1 << 40], [])] == [1, 2, 4, 8, 1]


def test_vectors_go_to_few_groups_and_once_to_each(spark, monkeypatch):
    n = V.shuffle_partitions(spark.range(1))
    key = spark.range(3000)

    def groups(words):
        return key.select(V.sum_group("id", key, words).alias("g")).distinct().count()

    floor = min(n, 2 * spark.sparkContext.defaultParallelism)
    assert groups(0) == floor and groups(V.SUM_WORDS * n) == n and groups(V.SUM_WORDS * n + 1) == 2 * n
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert groups(0) == min(64, 2 * spark.sparkContext.defaultParallelism)
        q = spark.createDataFrame([(i, [1, 2, i % 7]) for i in range(400)], "qid bigint, word_ids array<bigint>").repartition(64, "qid")
        vectors = spark.createDataFrame([(i, [float(i)]) for i in range(7)], "wid bigint, features array<double>")
        monkeypatch.setattr(V, "_added", lambda facts, *more, f=V._added: (lambda add: lambda a, b: (
            add(a, b) if b["wid"].to_pandas().is_unique else 1 / 0))(f(facts, *more)))
        got = {r.qid: r.features for r in V.question_features(q, vectors, columns=["features"]).collect()}
        assert got == {i: [3.0 + i % 7] for i in range(400)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
