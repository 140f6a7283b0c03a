"""Every registered query against its DuckDB oracle at sf0.001 (driver runs sf0.01)."""
import pytest

import __spark_entry__ as E
from conftest import SMALL
from pairlens.plans import catalog

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    import sys, os
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))
    from check_oracle import duck
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, con, name):
    from check_oracle import rows_of
    sdf = QUERIES[name](spark, SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.sql(ORACLE[name])
    assert sorted(sdf.columns) == sorted(cur.columns)
    assert rows_of(sdf.columns, srows) == rows_of(cur.columns, cur.fetchall())


def test_every_query_has_oracle_or_is_exempt():
    exempt = {"pca_words", "train_lr", "train_gbt", "train_svm", "train_mlp",
              "cv_metrics", "model_report_lr", "predict_pairs"}
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == exempt
    assert set(catalog.QUERIES) <= set(QUERIES)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["q1", "q2", "label"]
