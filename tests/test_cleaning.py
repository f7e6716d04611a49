import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fixtures import greenhouse_beds, to_spark
from tabloom.operators import clean


def test_target_never_dropped(spark):
    pdf = greenhouse_beds()
    pdf["pests"] = pdf["pests"].astype(float)
    pdf.loc[:87, "pests"] = np.nan               # 80 % missing target
    r = clean.clean_table(to_spark(spark, pdf), "pests")
    assert "pests" in r.table.columns
    assert "pests" not in r.report["columns_dropped"]


def test_threshold_zero_drops_any_gappy_column(spark):
    pdf = greenhouse_beds()
    pdf.loc[::10, "light"] = np.nan
    df = to_spark(spark, pdf)
    assert clean.sparse_columns(df, 0.0, keep=("pests",)) == ["light"]


def test_high_missing_column_dropped(spark):
    pdf = greenhouse_beds()
    pdf["junk"] = np.where(np.arange(len(pdf)) < 77, np.nan, 1.0)
    r = clean.clean_table(to_spark(spark, pdf), "pests")
    assert r.report["columns_dropped"] == ["junk"]


def test_ten_null_targets_dropped(spark):
    pdf = greenhouse_beds(80)
    pdf["pests"] = pdf["pests"].astype(float)
    pdf.loc[:9, "pests"] = np.nan
    r = clean.clean_table(to_spark(spark, pdf), "pests")
    assert r.report["target_missing_dropped"] == 10
    assert r.table.count() == 70


def test_duplicates_removed(spark):
    pdf = pd.concat([greenhouse_beds(40)] * 2, ignore_index=True)
    r = clean.clean_table(to_spark(spark, pdf), "pests")
    assert r.report["duplicates_removed"] == 40
    row = clean.duplicates_removed(to_spark(spark, pdf)).first()
    assert (row["n_before"], row["n_after"], row["duplicates_removed"]) == (80, 40, 40)


def test_median_and_mode_imputation(spark):
    pdf = greenhouse_beds(130, seed=51)
    pdf.loc[:19, "light"] = np.nan
    pdf.loc[30:39, "house"] = None
    df = to_spark(spark, pdf)
    out, med = clean.impute_median(df, ["light"])
    assert med["light"] == pytest_approx(pdf["light"].median())
    assert out.where(F.col("light").isNull()).count() == 0
    out2, modes = clean.impute_mode(df, ["house"])
    expect = pdf["house"].mode().sort_values().iloc[0]
    assert modes["house"] == expect
    assert out2.where(F.col("house").isNull()).count() == 0


def test_mode_of_all_missing_column_is_constant(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k INT, c STRING")
    out, modes = clean.impute_mode(df, ["c"])
    assert modes == {"c": "missing"}


def test_outliers_clipped_and_missing_kept(spark):
    pdf = greenhouse_beds(90, seed=63)
    pdf.loc[0, "light"] = 1e9
    pdf.loc[1, "light"] = -999_999
    df = to_spark(spark, pdf)
    out, report = clean.iqr_clip(df, ["light"])
    q1, q3 = pdf["light"].quantile([0.25, 0.75])
    lo, hi = q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1)
    r = report.first()
    assert r["n_clipped"] == 2
    assert r["lower"] == round(lo, 4) and r["upper"] == round(hi, 4)
    vals = [x["light"] for x in out.select("light").collect()]
    assert max(vals) == pytest_approx(hi) and min(vals) == pytest_approx(lo)
    nulls = spark.createDataFrame([(None,), (1.0,), (2.0,)], "x DOUBLE")
    assert clean.clip_columns(nulls, {"x": (0.0, 1.5)}).where("x IS NULL").count() == 1


def test_constant_column_not_clipped(spark):
    df = spark.createDataFrame([(5.0,)] * 10, "c DOUBLE")
    out, report = clean.iqr_clip(df, ["c"])
    assert report.count() == 0


def pytest_approx(x):
    import pytest
    return pytest.approx(x, rel=1e-9, abs=1e-9)
