"""Stream scoring resumes from its checkpoint: a restart scores only new files."""
import os

from pyspark.sql import functions as F

from pairlens.operators import evaluate as EV
from pairlens.sources import text_formats as S
from pairlens.streaming.score import score_stream


def write_lines(path, name, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_restart_scores_only_new_files(spark, tmp_out):
    qf = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [9])], "qid bigint, words array<bigint>")
    src, sink, ckpt = f"{tmp_out}/in", f"{tmp_out}/out", f"{tmp_out}/ckpt"
    write_lines(src, "a.csv", ["q1,q2", "Q1,Q2", "Q1,Q3"])
    score_stream(spark, src, qf, ["jaccard_set"], sink, ckpt, scorer=EV.rule_scorer).awaitTermination()
    assert S.read_predictions(spark, sink).count() == 2
    write_lines(src, "b.csv", ["q1,q2", "Q2,Q3"])
    score_stream(spark, src, qf, ["jaccard_set"], sink, ckpt, scorer=EV.rule_scorer).awaitTermination()
    out = {(r.q1, r.q2): r.prediction for r in S.read_predictions(spark, sink).collect()}
    assert out == {(1, 2): 1, (1, 3): 0, (2, 3): 0}   # each pair scored exactly once
    assert S.read_predictions(spark, sink).groupBy("q1", "q2").count().filter(F.col("count") > 1).count() == 0
