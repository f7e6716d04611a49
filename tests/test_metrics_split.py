import itertools

import numpy as np
import pandas as pd
import pytest

from tabloom.operators import metrics, rank, split


def brute_auc(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a != 1]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_binary_with_ties(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.uniform(size=300) + 0.3 * y, 1)        # many ties
    df = spark.createDataFrame(pd.DataFrame({"model": "m", "y": y, "score": s}))
    got = metrics.auc_binary(df).first()["roc_auc"]
    assert got == pytest.approx(round(brute_auc(y, s), 4))


def test_prf_weighted_matches_manual(spark):
    y = ["a", "a", "b", "b", "b", "c"]
    p = ["a", "b", "b", "b", "c", "a"]
    df = spark.createDataFrame(pd.DataFrame({"model": "m", "y": y, "pred": p}))
    r = metrics.prf_weighted(df).first()
    # per class precision a=1/2 b=2/3 c=0; recall a=1/2 b=2/3 c=0; support 2,3,1
    assert r["precision_weighted"] == round((0.5 * 2 + 2 / 3 * 3) / 6, 4)
    assert r["recall_weighted"] == round((0.5 * 2 + 2 / 3 * 3) / 6, 4)
    assert metrics.accuracy(df).first()["accuracy"] == round(3 / 6, 4)


def test_regression_metrics(spark):
    df = spark.createDataFrame(pd.DataFrame({"model": "m", "y": [1.0, 2.0, 3.0],
                                             "pred": [1.0, 2.5, 2.0]}))
    r = metrics.regression_metrics(df).first()
    assert r["mae"] == round(1.5 / 3, 4) and r["mse"] == round(1.25 / 3, 4)
    assert r["r2"] == round(1 - 1.25 / 2.0, 4)


def test_split_sizes_exact_and_disjoint(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    train, test = split.train_test_split(df, "k")
    assert (train.count(), test.count()) == (800, 200)
    chk = {r["check"]: r["n"] for r in split.split_partition_check(df, train, test, "k").collect()}
    assert chk["n_overlap"] == 0 and chk["n_missing"] == 0
    again, _ = split.train_test_split(df, "k")
    assert sorted(r.k for r in train.collect()) == sorted(r.k for r in again.collect())


def test_split_small_table_train_equals_test(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    train, test = split.train_test_split(df, "k")
    assert train.count() == test.count() == 10


def test_ranking_ties_by_name_and_missing_last(spark):
    rows = [("b", "f1_weighted", 0.8), ("a", "f1_weighted", 0.8), ("c", "accuracy", 0.9),
            ("a", "train_duration_seconds", 100.0), ("b", "train_duration_seconds", 1.0)]
    m = spark.createDataFrame(rows, "model STRING, metric STRING, value DOUBLE")
    got = [(r.rk, r.model) for r in rank.rank_models(m, "classification").orderBy("rk").collect()]
    assert got == [(1, "a"), (2, "b"), (3, "c")]
    reg = spark.createDataFrame([("x", "rmse", 2.0), ("y", "rmse", 1.0)],
                                "model STRING, metric STRING, value DOUBLE")
    assert rank.rank_models(reg, "regression").orderBy("rk").first().model == "y"
