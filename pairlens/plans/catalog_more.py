"""Registered queries, part two: files, evaluation, models, profile, dates, stream.

Queries that exercise a sink write into a fresh folder under the shared
checkpoint directory when they are built and return the frame read back,
so the check covers writer and reader together.
"""

from __future__ import annotations

from functools import partial, reduce
from multiprocessing.pool import ThreadPool
from threading import Lock

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from pairlens.functions.dates import parse_time, render_time
from pairlens.functions.ids import encode_id
from pairlens.operators import components as C
from pairlens.operators import evaluate as EV
from pairlens.operators import incremental as I
from pairlens.operators import pairs as P
from pairlens.operators.split import with_fold, with_split
from pairlens.operators.vectors import question_features, question_vector_rows, reduce_word_vectors
from pairlens.plans import flows
from pairlens.plans.scoring import PairScorer
from pairlens.plans.catalog import Context, r6, register, with_unknown
from pairlens.plans.models import MODELS, PCA_K
from pairlens.plans.oracle_sql import r6 as sql_r6
from pairlens.plans.oracle_sql import with_ctes
from pairlens.schema import TIME_FORMAT
from pairlens.session import reliable_checkpoint, scratch_path
from pairlens.sinks import files as K
from pairlens.sources import rejects as R
from pairlens.sources import sketches as SK
from pairlens.sources import text_formats as S
from pairlens.sources.profile import profile, profiles
from pairlens.sources.testdata import prepare, table
from pairlens.streaming.score import score_stream

# -- step 6: text formats, predictions, submission -------------------------------------

@register("embedding_text_roundtrip", with_ctes(
    f"SELECT wid, dim, {sql_r6('x')} AS value FROM wv", "wv"))
def q_embedding_text_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "word_embed")
    K.write_embeddings(prepare(spark, sf_dir).word_vec, path)
    back = S.read_embeddings(spark, path)
    return back.select("wid", F.posexplode("features").alias("dim", "value")) \
        .select("wid", F.col("dim").cast("bigint").alias("dim"), r6("value").alias("value"))


_QUESTION_CHECK_SQL = with_ctes("""
SELECT q.qid, coalesce(w.n_words, 0) AS n_words, coalesce(w.word_sum, 0)::BIGINT AS word_sum,
       c.n_chars, c.char_sum::BIGINT AS char_sum
FROM question q
LEFT JOIN (SELECT qid, count(*) AS n_words, sum((pos + 1) * wid) AS word_sum FROM tokv GROUP BY qid) w
       ON w.qid = q.qid
JOIN (SELECT doc_id, count(*) AS n_chars, sum(i * unicode(ch)) AS char_sum
      FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch,
                   generate_subscripts(string_split(text, ''), 1) AS i FROM documents) x
      GROUP BY doc_id) c ON c.doc_id = q.qid""", "question", "tokv")


@register("question_text_roundtrip", _QUESTION_CHECK_SQL)
def q_question_text_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "question_csv")
    K.write_questions(prepare(spark, sf_dir).question(with_chars=True), path, compression="gzip")
    back = S.read_questions(spark, path)

    def checksum(col):
        return F.aggregate(F.zip_with(col, F.sequence(F.lit(1), F.greatest(F.size(col), F.lit(1))),
                                      lambda x, i: x * i),
                           F.lit(0).cast("bigint"), lambda acc, v: acc + F.coalesce(v, F.lit(0)))

    return back.select("qid", F.size("word_ids").cast("bigint").alias("n_words"),
                       checksum(F.col("word_ids")).alias("word_sum"),
                       F.size("char_ids").cast("bigint").alias("n_chars"),
                       checksum(F.col("char_ids")).alias("char_sum"))


@register("pair_text_roundtrip", with_ctes("SELECT label, q1, q2 FROM train_pair", "train_pair"))
def q_pair_text_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "train_csv")
    K.write_train_pairs(prepare(spark, sf_dir).train_pair, path)
    return S.read_train_pairs(spark, path)


@register("test_pair_text_roundtrip", with_ctes(
    "SELECT q1, q2, row_number() OVER (ORDER BY row_no) - 1 AS row_no FROM test_pair", "test_pair"))
def q_test_pair_text_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "test_csv")
    K.write_test_pairs(prepare(spark, sf_dir).test_pair, path)
    return S.read_test_pairs(spark, path)


@register("char_embedding_roundtrip", with_ctes(
    f"SELECT wid AS cid, dim, {sql_r6('x')} AS value FROM wv", "wv"))
def q_char_embedding_roundtrip(spark, sf_dir):
    """Character vectors (one per code point id) through their file format."""
    path = scratch_path(spark, "char_embed")
    vectors = prepare(spark, sf_dir).word_vec.withColumnRenamed("wid", "cid")
    K.write_embeddings(vectors, path, id_col="cid", prefix=K.CHAR_PREFIX)
    back = S.read_char_embeddings(spark, path)
    return back.select("cid", F.posexplode("features").alias("dim", "value")) \
        .select("cid", F.col("dim").cast("bigint").alias("dim"), r6("value").alias("value"))


@register("question_char_vector", with_ctes(f"""
SELECT q.qid, d.dim, {sql_r6('coalesce(s.value, 0.0)')} AS value FROM question q JOIN dims d ON TRUE LEFT JOIN (
    SELECT c.doc_id, wv.dim, sum(wv.x) AS value FROM (
        SELECT doc_id, unicode(unnest(string_split(text, ''))) AS cid FROM documents) c JOIN wv ON wv.wid = c.cid
    GROUP BY c.doc_id, wv.dim) s ON s.doc_id = q.qid AND s.dim = d.dim""", "question", "dims", "wv"))
def q_question_char_vector(spark, sf_dir):
    """Sums of character vectors per question, by the same operator as for words."""
    fx = prepare(spark, sf_dir)
    chars = fx.question(with_chars=True).select("qid", F.col("char_ids").alias("word_ids"))
    rows = question_vector_rows(question_features(chars, fx.word_vec, columns=["features"]))
    return rows.select("qid", "dim", r6("value").alias("value"))


def _broken_lines(spark, sf_dir):
    """kind -> lines of its format, some of them headers or malformed, made from the tables."""
    fx = prepare(spark, sf_dir)
    vectors = fx.word_vec.select(F.col("wid").cast("string").alias("i"), "wid")
    questions = fx.question().select(F.col("qid").cast("string").alias("i"), "qid")
    pairs = fx.train_pair.select(F.col("q1").cast("string").alias("a"), F.col("q2").cast("string").alias("b"), "label", "q1")
    line = lambda *parts: F.concat(*[F.lit(p) if p[:1] != "$" else F.col(p[1:]) for p in parts])
    return {
        "word_embed": vectors.select(F.when(F.expr("wid % 7 = 0"), line("W", "$i", " 0.5 abc 1"))
                                     .when(F.expr("wid % 11 = 0"), line("Wx", "$i", " 0.5 1 2")).when(F.expr("wid % 13 = 0"), line("W", "$i"))
                                     .otherwise(line("W", "$i", " 0.5 1 -2e3")).alias("value")),
        "question": questions.select(F.when(F.expr("qid % 5 = 0"), line("Q-1", "$i", ",W1 W2,L1"))
                                     .when(F.expr("qid % 6 = 0"), line("Q", "$i", ",W1 W2")).when(F.expr("qid % 7 = 0"), line("Q", "$i", ",W1 x W2,L1"))
                                     .when(F.expr("qid % 11 = 0"), F.lit("qid,words,chars")).otherwise(line("Q", "$i", ",W1 W2,L1")).alias("value")),
        "train": pairs.select(F.when(F.expr("q1 % 5 = 0"), line("yes,Q", "$a", ",Q", "$b")).when(F.expr("q1 % 6 = 0"), line("1,Q", "$a"))
                              .when(F.expr("q1 % 7 = 0"), line("0,Q", "$a", ",", "$b", "Q")).when(F.expr("q1 % 11 = 0"), F.lit("label,q1,q2"))
                              .otherwise(line("1,Q", "$a", ",Q", "$b")).alias("value")),
        "test": pairs.select(F.when(F.expr("q1 % 5 = 0"), line("Q", "$a", ",Q")).when(F.expr("q1 % 6 = 0"), line("Q", "$a", ",Q", "$b", ",Q1"))
                             .when(F.expr("q1 % 11 = 0"), F.lit("q1,q2")).otherwise(line("Q", "$a", ",Q", "$b")).alias("value")),
    }


def _rejected_sql():
    cases = {"word_embed": ("word_vec", "wid % 7 = 0 number wid % 11 = 0 id wid % 13 = 0 fields"),
             "question": ("question", "qid % 5 = 0 id qid % 6 = 0 fields qid % 7 = 0 list qid % 11 = 0 header"),
             "train": ("train_pair", "q1 % 5 = 0 number q1 % 6 = 0 fields q1 % 7 = 0 id q1 % 11 = 0 header"),
             "test": ("train_pair", "q1 % 5 = 0 id q1 % 6 = 0 fields q1 % 11 = 0 header")}
    parts = []
    for kind, (source, rule) in cases.items():
        words = rule.split()
        when = " ".join(f"WHEN {' '.join(words[i:i + 5])} THEN '{words[i + 5]}'" for i in range(0, len(words), 6))
        parts.append(f"SELECT '{kind}' AS source, coalesce(reason, 'row') AS reason, count(*) AS n_lines, count(*) AS n_observed "
                     f"FROM (SELECT CASE {when} END AS reason FROM {source}) GROUP BY reason")
    return with_ctes(" UNION ALL ".join(parts), "word_vec", "question", "train_pair")


@register("rejected_lines", _rejected_sql())
def q_rejected_lines(spark, sf_dir):
    """Lines per source and reason: counted on the lines themselves, and observed while the rows were written."""
    out = []
    for kind, lines in _broken_lines(spark, sf_dir).items():
        path, rows_path = scratch_path(spark, f"{kind}_lines"), scratch_path(spark, f"{kind}_rows")
        lines.write.text(path)
        rows, counts = R.read_counted(spark, path, kind)
        rows.write.parquet(rows_path)
        seen = [(("row" if k == "n_rows" else k), n) for k, n in counts.get.items() if k != "n_lines" and n]
        told = R.read_rejects(spark, path, kind).groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines")).unionByName(
            spark.read.parquet(rows_path).agg(F.lit("row").alias("reason"), F.count(F.lit(1)).alias("n_lines")))
        out.append(told.join(spark.createDataFrame(seen, "reason string, n_observed bigint"), "reason", "full")
                   .select(F.lit(kind).alias("source"), "reason", "n_lines", "n_observed"))
    return reduce(lambda a, b: a.unionByName(b), out)


def _rule_scored_train(spark, sf_dir):
    ctx = Context(spark, sf_dir)
    return EV.rule_scorer(ctx.features(["jaccard_set"]))


def _rule_scored_test(spark, sf_dir, test_pair=None):
    ctx = Context(spark, sf_dir)
    tp = test_pair if test_pair is not None else ctx.fx.test_pair
    pf = P.pair_features(tp, ctx.pair_qf(["jaccard_set"]), ["jaccard_set"], keep=["row_no"])
    return EV.rule_scorer(pf)


@register("prediction_json_roundtrip", with_ctes(
    f"SELECT q1, q2, prediction, {sql_r6('p0')} AS p0, {sql_r6('p1')} AS p1 FROM scored_pred",
    "scored_pred"))
def q_prediction_json_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "prediction")
    K.write_predictions(_rule_scored_train(spark, sf_dir), path)
    back = S.read_predictions(spark, path)
    return back.select("q1", "q2", "prediction", r6("p0").alias("p0"), r6("p1").alias("p1"))


@register("submission", with_ctes(
    f"SELECT row_number() OVER (ORDER BY row_no) - 1 AS row_no, {sql_r6('p1')} AS y_pre FROM test_scored",
    "test_scored"))
def q_submission(spark, sf_dir):
    test_path, pred_path, sub_path = (scratch_path(spark, n) for n in ("test_csv", "prediction", "submission"))
    K.write_test_pairs(prepare(spark, sf_dir).test_pair, test_path)
    tests = S.read_test_pairs(spark, test_path)
    K.write_predictions(_rule_scored_test(spark, sf_dir, tests), pred_path)
    K.write_submission(tests, S.read_predictions(spark, pred_path), sub_path)
    lines = S.read_lines_in_order(spark, sub_path, keep=F.col("value") != "y_pre")
    return lines.select("row_no", r6(F.col("value").cast("double")).alias("y_pre"))


@register("stream_score_pairs", with_ctes(
    f"SELECT q1, q2, prediction, {sql_r6('p0')} AS p0, {sql_r6('p1')} AS p1 FROM test_scored",
    "test_scored"))
def q_stream_score_pairs(spark, sf_dir):
    src, sink, ckpt = (scratch_path(spark, n) for n in ("stream_in", "stream_out", "stream_ckpt"))
    ctx = Context(spark, sf_dir)
    K.write_test_pairs(ctx.fx.test_pair, src)
    query = score_stream(spark, src, ctx.pair_qf(["jaccard_set"]), ["jaccard_set"], sink, ckpt, scorer=EV.rule_scorer)
    query.awaitTermination()
    back = S.read_predictions(spark, sink)
    return back.select("q1", "q2", "prediction", r6("p0").alias("p0"), r6("p1").alias("p1"))


@register("stream_score_once", with_ctes(
    f"SELECT q1, q2, prediction, {sql_r6('p0')} AS p0, {sql_r6('p1')} AS p1 FROM test_scored "
    f"UNION ALL SELECT q2, q1, prediction, {sql_r6('p0')}, {sql_r6('p1')} FROM test_scored", "test_scored"))
def q_stream_score_once(spark, sf_dir):
    """Every test pair comes in files of two runs, the second time with its reverse: one prediction for each ordered pair."""
    src, sink, ckpt = (scratch_path(spark, n) for n in ("stream_in", "stream_out", "stream_ckpt"))
    ctx = Context(spark, sf_dir)
    pairs = ctx.fx.test_pair.select("q1", "q2")
    qf = ctx.pair_qf(["jaccard_set"])
    for arriving in (pairs, pairs.union(pairs.select("q2", "q1"))):
        arriving.select(encode_id(K.QUESTION_PREFIX, "q1").alias("q1"), encode_id(K.QUESTION_PREFIX, "q2").alias("q2")) \
            .write.mode("append").option("header", True).csv(src)
        score_stream(spark, src, qf, ["jaccard_set"], sink, ckpt, scorer=EV.rule_scorer, dedupe_within="1 day",
                     by_batch=True).awaitTermination()
    back = S.read_predictions(spark, f"{sink}/batch-*")
    return back.select("q1", "q2", "prediction", r6("p0").alias("p0"), r6("p1").alias("p1"))


# -- step 7: evaluation on the deterministic scorer ----------------------------------------

@register("eval_logloss", with_ctes(
    f"SELECT {sql_r6('avg(-ln(p1))')} AS logloss, count(*) AS n_predicted_positive "
    "FROM scored_pred WHERE prediction = 1", "scored_pred"))
def q_eval_logloss(spark, sf_dir):
    out = EV.positive_logloss(_rule_scored_train(spark, sf_dir))
    return out.select(r6("logloss").alias("logloss"), "n_predicted_positive")


@register("eval_logloss_standard", with_ctes(
    "SELECT " + sql_r6("avg(-(label * ln(greatest(least(p1, 1 - 1e-15), 1e-15)) "
                       "+ (1 - label) * ln(1 - greatest(least(p1, 1 - 1e-15), 1e-15))))")
    + " AS logloss_standard, count(*) AS n_rows FROM scored_pred", "scored_pred"))
def q_eval_logloss_standard(spark, sf_dir):
    out = EV.logloss(_rule_scored_train(spark, sf_dir))
    return out.select(r6("logloss_standard").alias("logloss_standard"), "n_rows")


@register("eval_accuracy", with_ctes(
    f"SELECT {sql_r6('avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END)')} AS accuracy, "
    "sum(CASE WHEN prediction = label THEN 1 ELSE 0 END)::BIGINT AS n_correct, count(*) AS n_rows FROM scored_pred",
    "scored_pred"))
def q_eval_accuracy(spark, sf_dir):
    out = EV.accuracy(_rule_scored_train(spark, sf_dir))
    return out.select(r6("accuracy").alias("accuracy"), "n_correct", "n_rows")


@register("eval_auc", with_ctes(
    f"SELECT {sql_r6('auc')} AS auc, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg FROM auc_value", "auc_value"))
def q_eval_auc(spark, sf_dir):
    out = EV.auc(_rule_scored_train(spark, sf_dir))
    return out.select(r6("auc").alias("auc"), "n_pos", "n_neg")


@register("eval_auc_one_class", "SELECT NULL::DOUBLE AS auc, 0::BIGINT AS n_pos, count(*) AS n_neg FROM ("
          + with_ctes("SELECT * FROM scored WHERE label = 0", "scored") + ") s")
def q_eval_auc_one_class(spark, sf_dir):
    out = EV.auc(_rule_scored_train(spark, sf_dir).filter("label = 0"))
    return out.select(r6("auc").alias("auc"), "n_pos", "n_neg")


@register("train_row_counts", with_ctes(
    "SELECT m.label, count(*) AS n_rows, count(*) AS n_used, sum(CASE WHEN isnan(m.cosine) OR isnan(j.jaccard) "
    "OR greatest(abs(m.chebyshev), abs(m.manhattan), m.euclidean) > 1e6 THEN 1 ELSE 0 END)::BIGINT AS n_replaced "
    "FROM pmetric m JOIN pjac j ON j.q1 = m.q1 AND j.q2 = m.q2 GROUP BY m.label", "pmetric", "pjac"))
def q_train_row_counts(spark, sf_dir):
    """Rows in, rows whose assembled vector a fit receives, and rows that the finite rule changes, per label.

    ``n_used`` counts what the assembler that the models are fitted with lets
    through; it would fail on NULL and the fit on NaN, so it is counted on the
    vectors themselves.
    """
    names = ["cosine", "chebyshev", "jaccard", "manhattan", "euclidean"]
    ctx = Context(spark, sf_dir)
    given = ctx.pairs.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    scorer = flows.new_scorer(names, "lr").bind_features(ctx.pair_qf(names))
    fitted = VectorAssembler(inputCols=names, outputCol="v", handleInvalid="skip").transform(scorer.pair_features(ctx.pairs))
    whole = F.forall(vector_to_array("v"), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = fitted.groupBy("label").agg(F.count_if(whole).alias("n_used"), F.count_if("replaced").alias("n_replaced"))
    return given.join(used, "label").select("label", "n_rows", "n_used", "n_replaced")


@register("predict_unknown", with_ctes(
    "SELECT q1, q2, true AS sums_to_one, true AS is_argmax FROM asked", "asked"))
def q_predict_unknown(spark, sf_dir):
    """A run that is not strict scores every pair, those with an unknown question included."""
    fx = prepare(spark, sf_dir)
    asked = with_unknown(Context(spark, sf_dir).pairs.select("q1", "q2"))
    return _proved(flows.score_pairs(_fitted_lr(spark, sf_dir).bind(fx.question(), fx.word_vec), asked, fx.question(), strict=False))


@register("cv_folds", with_ctes(
    "SELECT q1, q2, (('0x' || substr(md5(concat_ws(':', q1::VARCHAR, q2::VARCHAR, '43')), 1, 8))::BIGINT % 100 % 3)::INTEGER "
    "AS fold FROM pair", "pair"))
def q_cv_folds(spark, sf_dir):
    return with_fold(Context(spark, sf_dir).pairs, 3, seed=42).select("q1", "q2", "fold")


@register("auc_by_fold", with_ctes(f"""
SELECT fold, {sql_r6('sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg))')} AS auc FROM (
    SELECT fold, p1, pos, neg, sum(neg) OVER (PARTITION BY fold ORDER BY p1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS below
    FROM (SELECT (('0x' || substr(md5(concat_ws(':', q1::VARCHAR, q2::VARCHAR, '43')), 1, 8))::BIGINT % 100 % 3)::INTEGER AS fold, p1,
                 sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg
          FROM scored GROUP BY fold, p1) c) r GROUP BY fold""", "scored"))
def q_auc_by_fold(spark, sf_dir):
    """What model selection compares: the exact AUC of each cross-validation fold's scored rows."""
    folded = with_fold(_rule_scored_train(spark, sf_dir), 3, seed=42)
    evaluator = EV.ExactAuc(scoreCol="p1")
    rows = [(k, evaluator.evaluate(folded.where(F.col("fold") == k))) for k in range(3)]
    return spark.createDataFrame(rows, "fold int, auc double").select("fold", r6("auc").alias("auc"))


_COMPONENTS = """
    {name}_edge AS (SELECT least(q1, q2) AS u, greatest(q1, q2) AS v FROM pair WHERE q1 <> q2 AND ({rule})
                    UNION SELECT greatest(q1, q2), least(q1, q2) FROM pair WHERE q1 <> q2 AND ({rule})),
    {name}_reach AS (SELECT q1 AS qid, q1 AS c FROM pair UNION SELECT q2, q2 FROM pair
                     UNION SELECT e.v, r.c FROM {name}_reach r JOIN {name}_edge e ON e.u = r.qid WHERE r.c < e.v),
    {name} AS (SELECT qid, min(c) AS c FROM {name}_reach GROUP BY qid)"""
_SIDE = "(('0x' || substr(md5(concat_ws(':', {c}::VARCHAR, '42')), 1, 8))::BIGINT % 100) < 80"


def _component_sql(name):
    a, b = _SIDE.format(c=f"{name}1.c"), _SIDE.format(c=f"{name}2.c")
    return (f"least({name}1.c, {name}2.c) AS component_{name}, CASE WHEN {a} AND {b} THEN 'train' "
            f"WHEN NOT {a} AND NOT {b} THEN 'test' ELSE 'between' END AS part_{name}")


@register("split_by_component", with_ctes(
    f"SELECT p.q1, p.q2, p.label, {_component_sql('linked')}, {_component_sql('same')} FROM pair p "
    + " ".join(f"JOIN {n} {n}{i} ON {n}{i}.qid = p.q{i}" for n in ("linked", "same") for i in (1, 2)), "pair").replace(
        "WITH ", "WITH RECURSIVE ", 1).replace(
        "\nSELECT p.q1, p.q2, p.label, least", "," + _COMPONENTS.format(name="linked", rule="TRUE") + ","
        + _COMPONENTS.format(name="same", rule="label = 1") + "\nSELECT p.q1, p.q2, p.label, least", 1))
def q_split_by_component(spark, sf_dir):
    """80/20 split by components of all pairs, and by components of the pairs labelled 1."""
    pairs = Context(spark, sf_dir).pairs
    linked = C.with_component_split(pairs, 80, seed=42).withColumnsRenamed({"component": "component_linked", "part": "part_linked"})
    same = C.with_component_split(pairs, 80, seed=42, linked_by="positive").select(
        "q1", "q2", F.col("component").alias("component_same"), F.col("part").alias("part_same"))
    return linked.join(same, ["q1", "q2"]).select("q1", "q2", "label", "component_linked", "part_linked",
                                                  "component_same", "part_same")


@register("eval_report", with_ctes(
    f"SELECT 'rule' AS app, 'logloss' AS metric, {sql_r6('avg(-ln(p1))')} AS value "
    "FROM scored_pred WHERE prediction = 1 "
    f"UNION ALL SELECT 'rule', 'auc', {sql_r6('auc')} FROM auc_value "
    f"UNION ALL SELECT 'rule', 'precision', {sql_r6('avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END)')} "
    "FROM scored_pred", "scored_pred", "auc_value"))
def q_eval_report(spark, sf_dir):
    out = EV.report(_rule_scored_train(spark, sf_dir), "rule")
    return out.select("app", "metric", r6("value").alias("value"))


# -- step 8: PCA, models, split, scoring ------------------------------------------------

@register("split_80_20", with_ctes(
    "SELECT q1, q2, label, CASE WHEN (('0x' || substr(md5(concat_ws(':', q1::VARCHAR, q2::VARCHAR, '42')), 1, 8))"
    "::BIGINT % 100) < 80 THEN 'train' ELSE 'test' END AS part FROM pair", "pair"))
def q_split_80_20(spark, sf_dir):
    return with_split(Context(spark, sf_dir).pairs, 80, seed=42).select("q1", "q2", "label", "part")


@register("pca_words")
def q_pca_words(spark, sf_dir):
    reduced, _ = reduce_word_vectors(prepare(spark, sf_dir).word_vec, PCA_K["lr"])
    return reduced.select("wid", F.posexplode("features").alias("dim", "value"))


_FITTED: dict = {}


def _fitted_lr(spark, sf_dir):
    """The LR scorer of all train pairs, fitted once per application and folder."""
    key = (spark.conf.get("spark.app.id", ""), sf_dir)
    if key not in _FITTED:
        fx = prepare(spark, sf_dir)
        _FITTED[key] = flows.fit_scorer(fx.question(), fx.word_vec, fx.train_pair, model="lr")
    return _FITTED[key]


def _proved(scored, *keep):
    """q1, q2 of scored rows and what holds for every one of them."""
    return scored.select("q1", "q2", *keep, (F.abs(F.col("p0") + F.col("p1") - 1) < 1e-9).alias("sums_to_one"),
                         (F.col("prediction") == (F.col("p1") > F.col("p0")).cast("double")).alias("is_argmax"))


@register("predict_saved", with_ctes(
    "SELECT q1, q2, row_number() OVER (ORDER BY row_no) - 1 AS row_no, true AS sums_to_one, true AS is_argmax, true AS same "
    "FROM test_pair", "test_pair"))
def q_predict_saved(spark, sf_dir):
    """A scorer is stored, loaded and bound anew: one prediction for each test row, equal to the first scorer's."""
    path, tests = scratch_path(spark, "scorer"), scratch_path(spark, "test_csv")
    fx = prepare(spark, sf_dir)
    first = _fitted_lr(spark, sf_dir)
    first.write().overwrite().save(path)
    K.write_test_pairs(fx.test_pair, tests)
    pairs = S.read_test_pairs(spark, tests)
    again = flows.score_pairs(PairScorer.load(path).bind(fx.question(), fx.word_vec), pairs, fx.question())
    before = flows.score_pairs(first.bind(fx.question(), fx.word_vec), pairs, fx.question()).select(
        "row_no", F.col("p1").alias("_p1"))
    return _proved(again.join(before, "row_no"), "row_no", (F.abs(F.col("p1") - F.col("_p1")) <= 1e-9).alias("same"))


@register("model_invariants", with_ctes("""
SELECT m.app, count(*) AS n_rows, count(*) AS n_argmax, CASE WHEN m.app = 'svm' THEN 0 ELSE count(*) END AS n_sums_to_one,
       count(*) AS n_labels
FROM (SELECT unnest(['lr', 'gbt', 'svm', 'mlp']) AS app) m JOIN (
    SELECT q1, q2 FROM pair WHERE (('0x' || substr(md5(concat_ws(':', q1::VARCHAR, q2::VARCHAR, '42')), 1, 8))::BIGINT % 100) >= 80) p
    ON TRUE GROUP BY m.app""", "pair"))
def q_model_invariants(spark, sf_dir):
    """Held-out rows of each of the four models: all there, predicted by the larger score, p0 + p1 = 1 (SVM: no p)."""
    parts = []
    for model, result in _all_trained(spark, sf_dir).items():
        scored = result.scored
        top = F.col("score") > 0 if model == "svm" else F.col("p1") > F.col("p0")
        parts.append(scored.agg(
            F.lit(model).alias("app"), F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("prediction") == top.cast("double")).alias("n_argmax"),
            F.count_if(F.abs(F.col("p0") + F.col("p1") - 1) < 1e-9).alias("n_sums_to_one"),
            F.count_if(F.col("label").isin(0, 1)).alias("n_labels")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("pca_invariants", with_ctes("""
SELECT d.k::BIGINT AS n_components, n.n::BIGINT AS n_words, true AS uncorrelated, true AS ordered, true AS keeps_variance
FROM (SELECT 16 AS k) d, (SELECT count(*) AS n FROM word_vec) n""", "word_vec"))
def q_pca_invariants(spark, sf_dir):
    """Reduced word vectors: components do not correlate, their variances fall, and none exceeds the vectors' whole variance."""
    word_vec = prepare(spark, sf_dir).word_vec
    reduced, basis = reduce_word_vectors(word_vec, PCA_K["lr"])
    k = PCA_K["lr"]
    x = [F.col("features")[i] for i in range(k)]
    moments = reduced.agg(
        F.count(F.lit(1)).alias("n_words"), *[F.var_pop(x[i]).alias(f"v{i}") for i in range(k)],
        *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i)])
    dim = basis.pc.numRows
    whole = word_vec.agg(sum((F.var_pop(F.col("features")[i]) for i in range(1, dim)), F.var_pop(F.col("features")[0])).alias("whole"))
    v = [F.col(f"v{i}") for i in range(k)]
    uncorrelated = reduce(lambda a, b: a & b, [F.abs(F.col(f"c{i}_{j}")) <= 1e-6 * v[0] for i in range(k) for j in range(i)])
    ordered = reduce(lambda a, b: a & b, [v[i] >= v[i + 1] - 1e-9 * v[0] for i in range(k - 1)])
    return moments.join(F.broadcast(whole), F.lit(True)).select(
        F.lit(k).cast("bigint").alias("n_components"), "n_words", uncorrelated.alias("uncorrelated"), ordered.alias("ordered"),
        (sum(v[1:], v[0]) <= F.col("whole") * (1 + 1e-9)).alias("keeps_variance"))


_TRAINED: dict = {}
_SHARED: dict = {}
_SHARING = Lock()


def _shared(spark, sf_dir, model):
    """An unfitted scorer and the features of all train pairs, once for the models with a basis of one size.

    One at a time, since two singular value decompositions at once in one driver may not converge.
    """
    key = (spark.conf.get("spark.app.id", ""), sf_dir, PCA_K[model])
    with _SHARING:
        if key not in _SHARED:
            fx = prepare(spark, sf_dir)
            scorer, features = flows.unfitted_pairs(fx.question(), fx.word_vec, fx.train_pair, model)
            _SHARED[key] = scorer, reliable_checkpoint(features)
        return _SHARED[key]


def _trained(spark, sf_dir, model):
    """Fit a model once per application and folder; its queries share it."""
    key = (spark.conf.get("spark.app.id", ""), sf_dir, model)
    if key not in _TRAINED:
        fx = prepare(spark, sf_dir)
        _TRAINED[key] = flows.train_evaluate(fx.question(), fx.word_vec, fx.train_pair, model=model, shared=_shared(spark, sf_dir, model))
    return _TRAINED[key]


def _all_trained(spark, sf_dir):
    """model -> its result.  Fits are many small jobs one after another, so the four models are fitted side by side."""
    prepare(spark, sf_dir)
    fit = inheritable_thread_target(spark)(partial(_trained, spark, sf_dir))
    with ThreadPool(len(MODELS)) as pool:
        return dict(zip(MODELS, pool.map(fit, MODELS)))


def _train(model):
    def run(spark, sf_dir):
        res = _trained(spark, sf_dir, model)
        return res.scored.select("q1", "q2", "label", F.col("prediction").cast("int").alias("prediction"),
                                 "p0", "p1")
    return run


for _m in ("lr", "gbt", "svm", "mlp"):
    register(f"train_{_m}")(_train(_m))


@register("cv_metrics")
def q_cv_metrics(spark, sf_dir):
    """Average exact AUC over the folds, per model and grid point."""
    rows = []
    for model, res in _all_trained(spark, sf_dir).items():
        rows += [(model, i, float(list(pm.values())[0]) if pm else None, float(m))
                 for i, (pm, m) in enumerate(zip(res.model.getEstimatorParamMaps(), res.avg_metrics))]
    return spark.createDataFrame(rows, "model string, param_index int, reg_param double, avg_metric double")


@register("model_reports", """
SELECT app, metric, true AS known, true AS in_range
FROM (SELECT unnest(['lr', 'gbt', 'svm', 'mlp']) AS app) a, (SELECT unnest(['logloss', 'auc', 'precision']) AS metric) m""")
def q_model_reports(spark, sf_dir):
    """The conclusion rows of all four models, each in its range.

    A log loss is known where a row is predicted positive with a probability (an SVM has none).
    """
    reports = [EV.report(res.scored, m, score="score") for m, res in _all_trained(spark, sf_dir).items()]
    value = F.col("value")
    fits = F.when(F.col("metric") == "logloss", value >= 0).otherwise((value >= 0) & (value <= 1))
    return reduce(lambda a, b: a.unionByName(b), reports).select(
        "app", "metric", (value.isNotNull() | (F.col("metric") == "logloss")).alias("known"), F.coalesce(fits, F.lit(True)).alias("in_range"))


@register("model_report_lr")
def q_model_report_lr(spark, sf_dir):
    return EV.report(_trained(spark, sf_dir, "lr").scored, "lr", score="score")


@register("predict_pairs")
def q_predict_pairs(spark, sf_dir):
    fx = prepare(spark, sf_dir)
    scored = flows.predict(fx.question(), fx.word_vec, fx.train_pair, fx.test_pair, model="lr")
    return K.prediction_frame(scored)


# -- step 9: profile and dates ---------------------------------------------------------------

@register("dataset_profile", with_ctes("""
SELECT 'question' AS source, count(*) AS n_rows, count(DISTINCT qid) AS n_keys,
       min(len(word_ids))::BIGINT AS min_len, max(len(word_ids))::BIGINT AS max_len FROM question
UNION ALL SELECT 'word_vec', count(*), count(DISTINCT wid), min(len(features))::BIGINT,
       max(len(features))::BIGINT FROM word_vec
UNION ALL SELECT 'train_pair', count(*), (SELECT count(*) FROM (SELECT DISTINCT q1, q2 FROM train_pair) d),
       NULL::BIGINT, NULL::BIGINT FROM train_pair
UNION ALL SELECT 'test_pair', count(*), (SELECT count(*) FROM (SELECT DISTINCT q1, q2 FROM test_pair) d),
       NULL::BIGINT, NULL::BIGINT FROM test_pair""", "question", "word_vec", "train_pair", "test_pair"))
def q_dataset_profile(spark, sf_dir):
    fx = prepare(spark, sf_dir)
    return profiles([
        profile("question", fx.question(), ["qid"], "word_ids"),
        profile("word_vec", fx.word_vec, ["wid"], "features"),
        profile("train_pair", fx.train_pair, ["q1", "q2"]),
        profile("test_pair", fx.test_pair, ["q1", "q2"]),
    ])


@register("profile_sketch", with_ctes("""
SELECT 'question' AS source, count(*) AS n_rows, min(len(word_ids))::BIGINT AS min_len, max(len(word_ids))::BIGINT AS max_len,
       true AS keys_within, true AS quantiles_within, 0::BIGINT AS read_again FROM question
UNION ALL SELECT 'word_vec', count(*), min(len(features))::BIGINT, max(len(features))::BIGINT, true, true, 0 FROM word_vec
UNION ALL SELECT 'train_pair', count(*), NULL::BIGINT, NULL::BIGINT, true, true, 0 FROM train_pair
UNION ALL SELECT 'test_pair', count(*), NULL::BIGINT, NULL::BIGINT, true, true, 0 FROM test_pair""",
    "question", "word_vec", "train_pair", "test_pair"))
def q_profile_sketch(spark, sf_dir):
    """The profile from merged per-file sketches, held against exact counts; a second update reads no file again."""
    fx, path, words = prepare(spark, sf_dir), scratch_path(spark, "sketches"), scratch_path(spark, "word_vec")
    fx.word_vec.write.parquet(words)
    sources = {"question": (fx.question(), ["qid"], "word_ids"), "word_vec": (spark.read.parquet(words), ["wid"], "features"),
               "train_pair": (fx.train_pair, ["q1", "q2"], None), "test_pair": (fx.test_pair, ["q1", "q2"], None)}
    again = {}
    for name, (df, keys, list_col) in sources.items():
        SK.update_sketches(spark, path, name, df, keys, list_col)
        again[name] = SK.update_sketches(spark, path, name, df, keys, list_col)
    exact = reduce(lambda a, b: a.unionByName(b), [
        df.agg(F.lit(name).alias("source"), F.count_distinct(*keys).alias("exact")) for name, (df, keys, _) in sources.items()])
    merged = SK.merged_profile(SK.read_sketches(spark, path)).join(exact, "source")
    ranks = [df.select(F.lit(name).alias("source"), F.size(list_col).cast("bigint").alias("n"))
             for name, (df, _, list_col) in sources.items() if list_col]
    # The ranks that a length takes must meet the bound around the quantile asked for.
    quantiles = [f"len_q{round(100 * q)}" for q in SK.QUANTILES]
    met = reduce(lambda a, b: a.unionByName(b), ranks).join(merged.select("source", *quantiles), "source").groupBy("source").agg(
        *[((F.avg((F.col("n") < F.col(c)).cast("double")) <= q + SK.RANK_BOUND)
           & (F.avg((F.col("n") <= F.col(c)).cast("double")) >= q - SK.RANK_BOUND)).alias(f"ok_{c}")
          for c, q in zip(quantiles, SK.QUANTILES)])
    met = met.select("source", reduce(lambda a, b: a & b, [F.col(f"ok_{c}") for c in quantiles]).alias("met"))
    times = spark.createDataFrame(list(again.items()), "source string, read_again bigint")
    return merged.join(met, "source", "left").join(times, "source").select(
        "source", "n_rows", "min_len", "max_len", (F.abs(F.col("n_keys") - F.col("exact")) <= SK.KEY_BOUND * F.col("exact")).alias("keys_within"),
        F.coalesce("met", F.lit(True)).alias("quantiles_within"), "read_again")


@register("incremental_question_vector", with_ctes(
    f"SELECT qid, dim, {sql_r6('value')} AS value FROM qvec", "qvec"))
def q_incremental_question_vector(spark, sf_dir):
    """Features of other questions (some missing, some with other words), brought up to date with the real ones."""
    fx, path = prepare(spark, sf_dir), scratch_path(spark, "features")
    question = fx.question().select("qid", "word_ids")
    before = question.where("qid % 10 != 0").withColumn(
        "word_ids", F.when(F.expr("qid % 7 = 0"), F.slice("word_ids", 1, 3)).otherwise(F.col("word_ids")))
    gone = question.where("qid % 50 = 1").withColumn("qid", -1 - F.col("qid"))
    I.update_features(before.unionByName(gone), fx.word_vec, path, columns=["features", "n_missing"])
    I.update_features(question, fx.word_vec, path, columns=["features", "n_missing"])
    rows = question_vector_rows(I.read_features(spark, path))
    return rows.select("qid", "dim", r6("value").alias("value"))


@register("date_render",
          "SELECT event_id, coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S'), '') AS ts_text FROM events")
def q_date_render(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", render_time("ts", TIME_FORMAT).alias("ts_text"))


@register("date_parse",
          "SELECT event_id, epoch(try_strptime(nullif(coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S'), ''), ''), "
          "'%Y-%m-%d %H:%M:%S'))::BIGINT AS epoch_seconds FROM events")
def q_date_parse(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    text = render_time("ts", TIME_FORMAT)
    return ev.select("event_id", F.unix_seconds(parse_time(text, TIME_FORMAT)).alias("epoch_seconds"))

