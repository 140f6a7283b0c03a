"""Reason-coded rejects of every format, counted while the rows are read."""
import pytest

from pairlens.sources import rejects as R
from pairlens.sources import text_formats as S

LINES = {
    "word_embed": ["W1 0.5 -1e3", "W2 0.5 x", "Wy 1 2", "W3", "", "W-4 1", "W5 1 2 "],
    "char_embed": ["L1 0.5", "L 1", "L7 nan"],
    "question": ["qid,words,chars", "Q1,W1 W2,L1", "Q2,,", "Q3,W1", "Q4,W1,L1,x", "Qz,W1,L1", "Q5,W1 q,L1", "Q6,W1,L", "Q-7,W1,L1", ""],
    "train": ["label,q1,q2", "1,Q1,Q2", "0,Q2,Q1", "x,Q1,Q2", "1,Q1", "1,Q1,Qz", "1,Q-1,Q2", "label,q1,q2"],
    "test": ["q1,q2", "Q1,Q2", "Q1", "Q1,Q2,Q3", "Qa,Q2", "Q1,"],
}
REASONS = {
    "word_embed": [None, "number", "id", "fields", "fields", "id", None],
    "char_embed": [None, "id", None],
    "question": ["header", None, None, "fields", "fields", "id", "list", "list", "id", "fields"],
    "train": ["header", None, None, "number", "fields", "id", "id", "header"],
    "test": ["header", None, "fields", "fields", "id", "id"],
}


@pytest.mark.parametrize("kind", sorted(LINES))
def test_reasons(spark, tmp_out, kind):
    spark.createDataFrame([(v,) for v in LINES[kind]], "value string").coalesce(1).write.text(f"{tmp_out}/{kind}")
    rows, counts = R.read_counted(spark, f"{tmp_out}/{kind}", kind)
    n = len(rows.collect())
    expected = REASONS[kind]
    assert counts.get == {"n_lines": len(expected), "n_rows": n, **{r: expected.count(r) for r in R.REASONS}}
    assert n == expected.count(None)
    assert sorted(map(tuple, R.read_rejects(spark, f"{tmp_out}/{kind}", kind).collect())) == sorted(
        (line, r) for line, r in zip(LINES[kind], expected) if r)
    bad = sum(r not in (None, "header") for r in expected)
    assert R.check_rejects(counts, bad)["n_lines"] == len(expected)
    with pytest.raises(ValueError, match="rejected"):
        R.check_rejects(counts, bad - 1)
    with pytest.raises(ValueError, match="rejected lines"):
        R.check_rejects(counts, {"header": 99})


def test_same_rows_as_the_plain_readers(spark, tmp_out):
    plain = {"question": S.read_questions, "train": S.read_train_pairs}
    for kind, read in plain.items():
        path = f"{tmp_out}/{kind}"
        good = [v for v, r in zip(LINES[kind], REASONS[kind]) if r in (None, "header")]
        spark.createDataFrame([(v,) for v in good], "value string").write.text(path)
        rows, _ = R.read_counted(spark, path, kind)
        assert sorted(map(str, rows.collect())) == sorted(map(str, read(spark, path).select(*rows.columns).collect()))


def test_counts_need_no_second_scan(spark, tmp_out):
    """The counts are there after a write of the rows, a model can be fitted in the same session afterwards."""
    spark.createDataFrame([(v,) for v in LINES["train"]], "value string").write.text(f"{tmp_out}/in")
    rows, counts = R.read_counted(spark, f"{tmp_out}/in", "train")
    rows.write.parquet(f"{tmp_out}/out")
    assert counts.get["n_rows"] == spark.read.parquet(f"{tmp_out}/out").count() == 2
    from pairlens.plans.models import cross_validator
    data = spark.createDataFrame([(float(i), i % 2, i % 3) for i in range(60)], "x double, label int, fold int")
    model = cross_validator("lr", ["x"]).fit(data)
    assert not model.bestModel.stages[-1].hasSummary and model.transform(data).count() == 60


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="unknown format"):
        R.parse_lines(spark.createDataFrame([("x",)], "value string"), "csv")
