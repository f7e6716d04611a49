"""Every registered query against its DuckDB oracle at sf0.01 (the driver's
correctness gate), and rows-only checks for the rest."""

import pytest

from conftest import FAST, SF001
from __spark_entry__ import oracle_sql, queries
from compare import digest
from tabloom.plans.oracles import ORACLES
from tabloom.plans.queries import QUERIES

SLOW = {"train_rf_classifier", "train_rf_regressor", "train_logreg", "train_gbt_classifier",
        "train_gbt_regressor", "train_one", "train_all", "score_holdout", "mi_neighbours_class",
        "mi_neighbours_number"}


def test_entry_registers_every_query():
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_every_query_has_oracle_or_is_model():
    missing = set(QUERIES) - set(ORACLES)
    assert missing <= SLOW, missing


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def assert_plan_ok(df):
    """No cross product and no nested-loop join anywhere in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(op in plan for op in FORBIDDEN), plan


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF001)
    assert_plan_ok(df)
    got = df.toPandas()
    want = duck.execute(ORACLES[key]).df()
    assert digest(got) == digest(want)


@pytest.mark.skipif(FAST, reason="model fits are slow")
@pytest.mark.parametrize("key", sorted(SLOW))
def test_rows_only(spark, key):
    pdf = QUERIES[key](spark, SF001).toPandas()
    assert len(pdf) > 0
    if "metric" in pdf.columns:
        for m in ("accuracy", "roc_auc", "f1_weighted"):
            vals = pdf.loc[pdf.metric == m, "value"]
            assert ((vals >= 0) & (vals <= 1)).all()
