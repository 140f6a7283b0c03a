"""Static guards: library code never pulls data to the driver or pairs rows blindly."""
import os
import re

ROOT = os.path.join(os.path.dirname(os.path.dirname(__file__)), "pairlens")


def sources():
    for d, _, files in os.walk(ROOT):
        for f in files:
            if f.endswith(".py"):
                p = os.path.join(d, f)
                yield p, open(p).read()


def test_no_collect_or_pandas_pull():
    for p, text in sources():
        assert not re.search(r"\.(collect|toPandas|localCheckpoint)\(", text), p


def test_no_cross_join():
    for p, text in sources():
        assert "crossJoin" not in text and '"cross"' not in text, p


def test_pair_metrics_stay_in_jvm(spark):
    from conftest import SMALL
    from pairlens.plans.catalog import Context
    pf = Context(spark, SMALL).features("all")
    plan = pf._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
