import os
import tempfile

import pandas as pd
import pytest

from conftest import FAST
from fixtures import greenhouse_beds, ferry_crossings, to_spark
from tabloom.operators import models, profile, runlog
from tabloom.sources import csv_ingest


def test_integer_01_target_is_numeric_and_classification(spark):
    df = to_spark(spark, greenhouse_beds())
    labels = {r["column"]: r["label"] for r in profile.column_types(df).collect()}
    assert labels["pests"] == "numeric"
    assert profile.detect_task_type(df, "pests") == "classification"
    assert profile.detect_task_type(to_spark(spark, ferry_crossings()), "minutes") == "regression"


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a DOUBLE, c DOUBLE")
    m = {(r.col_a, r.col_b): r.corr for r in profile.correlation_matrix(df, ["a", "c"]).collect()}
    assert m[("a", "a")] == 1.0 and m[("a", "c")] is None and m[("c", "a")] is None


def test_missing_report_counts_nan(spark):
    df = spark.createDataFrame([(float("nan"), "x"), (1.0, None), (2.0, "y"), (3.0, "z")],
                               "a DOUBLE, b STRING")
    got = {r["column"]: (r["n_missing"], r["pct"]) for r in profile.missing_report(df).collect()}
    assert got == {"a": (1, 25.0), "b": (1, 25.0)}


def test_class_balance_denominator_includes_missing(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t STRING")
    got = {r["class"]: r["pct"] for r in profile.class_balance(df, "t").collect()}
    assert got == {"a": 50.0, "b": 25.0}


def _write(path, text, encoding="utf-8"):
    with open(path, "wb") as f:
        f.write(text.encode(encoding))


def test_csv_ingest_types_na_and_quarantine(spark):
    d = tempfile.mkdtemp(prefix="tabloom-csv-")
    _write(os.path.join(d, "a.csv"),
           "age,salary,flag,name,when\n1,10.5,True,ann,2020-01-01\nNA,n/a,False,bob,2020-01-02\n"
           "3,12,true,,2020-01-03\n4,13,false,dan,2020-01-04,EXTRA,FIELD\n")
    got = csv_ingest.ingest_csv(spark, d)
    assert got.types == {"age": "bigint", "salary": "double", "flag": "boolean",
                         "name": "string", "when": "string"}
    assert got.table.count() == 3 and got.quarantine.count() == 1
    assert got.table.where("age IS NULL").count() == 1


def test_csv_latin1_detected(spark):
    d = tempfile.mkdtemp(prefix="tabloom-csv-")
    _write(os.path.join(d, "b.csv"), "city,n\nMünchen,1\nZürich,2\n", encoding="latin-1")
    got = csv_ingest.ingest_csv(spark, d)
    assert got.encoding == "ISO-8859-1"
    assert sorted(r.city for r in got.table.collect()) == ["München", "Zürich"]


def test_header_only_csv_refused(spark):
    d = tempfile.mkdtemp(prefix="tabloom-csv-")
    _write(os.path.join(d, "c.csv"), "col1,col2\n")
    with pytest.raises(csv_ingest.IngestError):
        csv_ingest.ingest_csv(spark, d)


def test_non_csv_refused(spark):
    d = tempfile.mkdtemp(prefix="tabloom-csv-")
    _write(os.path.join(d, "c.txt"), "a,b\n1,2\n")
    with pytest.raises(csv_ingest.IngestError):
        csv_ingest.ingest_csv(spark, d)


def test_run_transitions(spark):
    rows = [(1, 1, "pending"), (1, 2, "running"), (1, 3, "completed"),
            (2, 4, "running"), (2, 5, "pending"), (3, 6, "pending"), (3, 7, "failed")]
    ev = spark.createDataFrame(rows, "run_id INT, seq INT, status STRING")
    got = {r.run_id: r.n_invalid for r in runlog.run_transitions_valid(ev).collect()}
    assert got == {1: 0, 2: 2, 3: 0}


def test_model_registry_rules(spark):
    assert models.supported_models(["logistic_regression", "random_forest", "nope"],
                                   "regression") == ["random_forest"]
    df = spark.createDataFrame([(1.0, 2.0)], "f DOUBLE, _label DOUBLE")
    with pytest.raises(models.ModelError):
        models.train_model("logistic_regression", df, df, ["f"], "_label", "regression")
    with pytest.raises(models.ModelError):
        models.train_model("unknown", df, df, ["f"], "_label", "classification")


@pytest.mark.skipif(FAST, reason="model fits are slow")
def test_train_all_classification(spark):
    pdf = greenhouse_beds(150)
    pdf["house"] = pdf["house"].map({"annex": 0.0, "dome": 1.0, "tunnel": 2.0})
    df = spark.createDataFrame(pdf.astype(float))
    done, errors = models.train_all(["random_forest", "logistic_regression"], df, df,
                                    ["moisture", "light", "house"], "pests", "classification", 2)
    assert errors == {} and len(done) == 2
    m = models.metrics_table(done).toPandas()
    assert set(m.model) == {"random_forest", "logistic_regression"}
    most = max(pdf["pests"].mean(), 1 - pdf["pests"].mean())       # the majority class
    assert (m[m.metric == "accuracy"].value > most).all()


def test_split_categoricals_counts_non_missing(spark):
    from tabloom.operators import encode
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z"), ("a", "w")],
                               "c1 STRING, c2 STRING")
    assert encode.split_categoricals(df, ["c1", "c2"], threshold=2) == (["c1"], ["c2"])


def test_orphan_runs_finds_missing_dataset(spark):
    latest = spark.createDataFrame([(1, 0), (2, 99)], "run_id INT, dataset_id INT")
    catalog = spark.createDataFrame([(0, "d0")], "dataset_id INT, name STRING")
    assert [r.run_id for r in runlog.orphan_runs(latest, catalog).collect()] == [2]


def test_paging_and_preview_bounds(spark):
    cat = spark.createDataFrame([(i, f"d{i}", None) for i in range(30)],
                                "dataset_id INT, name STRING, created_at TIMESTAMP")
    page = runlog.page_newest(cat, skip=5, limit=10).collect()
    assert [r.dataset_id for r in page] == list(range(5, 15))
    for bad in ({"skip": -1, "limit": 10}, {"skip": 0, "limit": 0}, {"skip": 0, "limit": 201}):
        with pytest.raises(ValueError):
            runlog.page_newest(cat, **bad)
    with pytest.raises(ValueError):
        profile.preview(cat, ["dataset_id"], 101)
    assert profile.preview(cat, ["dataset_id"], 3).count() == 3
