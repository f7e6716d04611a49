"""End-to-end run on the smallest driver tables (the flagship path)."""

from conftest import SF0001
from tabloom.plans.experiment import PlanError, run_experiment
from tabloom.sources.tables import order_features

import pytest


def test_run_experiment_end_to_end(spark):
    df = order_features(spark, SF0001)
    res = run_experiment(df, "o_orderstatus", id_col="o_orderkey",
                         config={"training": {"models": ["logistic_regression"]}})
    assert res.status == "completed", res.errors
    assert [s[0] for s in res.stages] == ["planner", "eda", "cleaning", "feature_engineering",
                                          "training", "evaluation", "report"]
    board = res.leaderboard.collect()
    assert len(board) == 1 and board[0]["model"] == "logistic_regression"
    assert 0 <= board[0]["accuracy"] <= 1
    assert board[0]["n_train"] + board[0]["n_test"] == df.count()
    assert res.structure.count() == len(df.columns)
    assert res.timeline(spark).count() == 7
    assert len(res.selected_features) <= 20


def test_bad_target_stops_the_run(spark):
    with pytest.raises(PlanError):
        run_experiment(order_features(spark, SF0001), "no_such_column")
