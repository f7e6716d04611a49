"""Sinks and round trips: CSV export read back by the ingest path, and a
fitted model saved and reloaded."""

import os
import tempfile

from pyspark.sql import functions as F

from tabloom.operators import models
from tabloom.sources import csv_ingest


def test_csv_roundtrip_keeps_types_and_values(spark):
    src = spark.createDataFrame(
        [(1, 2.5, "a", True), (2, None, "b", False), (3, 4.0, None, None)],
        "k BIGINT, x DOUBLE, s STRING, b BOOLEAN")
    d = tempfile.mkdtemp(prefix="tabloom-rt-")
    out = os.path.join(d, "t")
    src.coalesce(1).write.option("header", True).csv(out)
    got = csv_ingest.ingest_csv(spark, out)
    assert got.types == {"k": "bigint", "x": "double", "s": "string", "b": "boolean"}
    assert sorted(got.table.collect()) == sorted(src.collect())


def test_land_refuses_overwrite(spark):
    d = tempfile.mkdtemp(prefix="tabloom-land-")
    df = spark.range(3)
    path = csv_ingest.land(df, d, "ds1")
    assert spark.read.parquet(path).count() == 3
    try:
        csv_ingest.land(df, d, "ds1")
        raise AssertionError("second landing under the same id must fail")
    except Exception as exc:  # noqa: BLE001
        assert "already exists" in str(exc).lower() or "path" in str(exc).lower()


def test_model_save_and_load(spark):
    rows = [(float(i % 7), float(i % 3), float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, _label DOUBLE")
    t = models.train_model("logistic_regression", df, df, ["a", "b"], "_label",
                           "classification", 2)
    path = models.save_model(t, os.path.join(tempfile.mkdtemp(prefix="tabloom-m-"), "m"))
    again = models.load_model(path)
    p1 = t.model.transform(df).select(F.sum("prediction")).first()[0]
    p2 = again.transform(df).select(F.sum("prediction")).first()[0]
    assert p1 == p2
