import pytest

from conftest import SMALL
from pairlens.operators import evaluate as EV
from pairlens.plans import flows
from pairlens.sources.testdata import prepare


@pytest.mark.parametrize("model", ["lr", "gbt", "svm", "mlp"])
def test_train_evaluate_structure(spark, model):
    fx = prepare(spark, "/root/testdata/sf0.01")
    res = flows.train_evaluate(fx.question(), fx.word_vec, fx.train_pair, model=model)
    rows = res.scored.select("label", "prediction", "p0", "p1").collect()
    assert rows and res.n_train > 0
    for r in rows:
        if r.p1 is not None:
            assert r.p0 + r.p1 == pytest.approx(1.0)
            assert r.prediction == (1.0 if r.p1 > r.p0 else 0.0)
    auc = EV.auc(res.scored, "score").first()["auc"]
    assert 0.7 <= auc < 1  # some labels of the fixture are noise


def test_predict_every_test_pair(spark):
    fx = prepare(spark, SMALL)
    scored = flows.predict(fx.question(), fx.word_vec, fx.train_pair, fx.test_pair, model="lr")
    assert scored.count() == fx.test_pair.count()


def test_scored_rows_written_as_json(spark, tmp_out):
    """K-01: held-out rows with model outputs (vectors as JSON objects)."""
    fx = prepare(spark, SMALL)
    res = flows.train_evaluate(fx.question(), fx.word_vec, fx.train_pair, model="lr",
                               output=f"{tmp_out}/cv_transformed")
    back = spark.read.json(f"{tmp_out}/cv_transformed")
    assert back.count() == res.scored.count()
    assert {"probability", "rawPrediction", "prediction", "label"} <= set(back.columns)


def test_output_layout_and_report_line():
    from pairlens.sinks.files import output_paths
    paths = output_paths("/data", "mlp")
    assert paths["cv_transformed"] == "/data/output/lmpc/cv_transformed"
    assert paths["prediction"] == "/data/output/lmpc/prediction"
    line = EV.markdown_row("lr", {"logloss": 0.5, "auc": 0.75, "precision": 0.7})
    assert line == "lr -> logloss, areaUnderRoc, precision, | 0.5 | 0.75 | 0.7 | | |"


def test_the_four_models_are_fitted_side_by_side(spark, monkeypatch):
    from threading import Barrier

    from pairlens.plans import catalog_more

    all_there = Barrier(4, timeout=60)

    def trained(spark, sf_dir, model):
        all_there.wait()
        return model.upper()

    monkeypatch.setattr(catalog_more, "_trained", trained)
    assert list(catalog_more._all_trained(spark, SMALL).items()) == [("lr", "LR"), ("gbt", "GBT"), ("svm", "SVM"), ("mlp", "MLP")]


def test_models_with_one_basis_size_share_their_pair_features(spark, monkeypatch):
    from pairlens.plans import catalog_more

    made = []
    real = flows.unfitted_pairs
    monkeypatch.setattr(flows, "unfitted_pairs", lambda *args, **kw: made.append(args[3]) or real(*args, **kw))
    monkeypatch.setattr(catalog_more, "_SHARED", {})
    monkeypatch.setattr(catalog_more, "_TRAINED", {})
    shared = {m: catalog_more._trained(spark, SMALL, m) for m in ("gbt", "svm")}
    assert made == ["gbt"]
    fx = prepare(spark, SMALL)
    for model, res in shared.items():
        own = flows.train_evaluate(fx.question(), fx.word_vec, fx.train_pair, model=model)
        assert own.n_train == res.n_train and own.avg_metrics == pytest.approx(res.avg_metrics)
        scored = [{(r.q1, r.q2, r.label): r.score for r in x.scored.collect()} for x in (own, res)]
        assert scored[0] == pytest.approx(scored[1])


def test_training_frame_has_no_more_partitions_than_its_rows_fill(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.range(0, 1000, 1, 20).withColumn("replaced", F.expr("id % 10 = 0"))
    for limit, parts in ((20_000, 1), (300, 4), (1, 20)):
        monkeypatch.setattr(flows, "PARTITION_ROWS", limit)
        kept, n, changed = flows.persisted_training_frame(rows)
        assert (kept.rdd.getNumPartitions(), n, changed, kept.agg(F.sum("id")).first()[0]) == (parts, 1000, 100, 499500)
        kept.unpersist()
