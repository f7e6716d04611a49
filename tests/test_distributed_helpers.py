"""The distributed helpers (radix ranks, salted top-k, bucketed lag, running sums)
forced on small data and compared with brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions import quantiles
from tabloom.functions.quantiles import column_quantiles, exact_quantiles, select_ranks
from tabloom.functions.ranking import previous_in_order, running_sums, top_k_per_group


@pytest.mark.parametrize("buckets", [65536, 8])
def test_exact_quantiles_match_numpy(spark, buckets, monkeypatch):
    monkeypatch.setattr(quantiles, "_EVEN", quantiles._EVEN.replace("65536", str(buckets))
                        .replace("65535", str(buckets - 1)))       # few buckets: many passes
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.normal(size=900), rng.normal(size=40) * 1e-300, rng.normal(size=40) * 1e300, [0.0] * 9])
    b = np.concatenate([np.full(400, 7.0), rng.integers(0, 20, 300).astype(float)])  # hot value
    rows = [("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "column STRING, value DOUBLE")
    got = exact_quantiles(df, [0.0, 0.25, 0.5, 0.9, 1.0])
    for g, arr in (("a", a), ("b", b)):
        for p in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert got[(g, p)] == pytest.approx(np.quantile(arr, p), rel=1e-12, abs=1e-12)


def test_select_ranks_reports_rows_below(spark):
    vals = [3.0, 1.0, 2.0, 2.0, 5.0, float("inf"), float("-inf")]
    df = spark.createDataFrame([("g", v) for v in vals], "g STRING, v DOUBLE")
    got = select_ranks(df, {("g", k) for k in range(7)})
    assert got[("g", 0)] == (float("-inf"), 0) and got[("g", 6)] == (float("inf"), 6)
    assert got[("g", 1)] == (1.0, 1)
    assert got[("g", 3)] == (2.0, 2)       # second of the two 2.0 rows; two rows below 2.0
    assert got[("g", 5)] == (5.0, 5)


def test_top_k_per_group_matches_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice(list("xyz"), 2000), "v": rng.integers(0, 300, 2000)})
    vc = pdf.groupby(["g", "v"]).size().rename("n").reset_index()
    df = spark.createDataFrame(vc)
    got = top_k_per_group(df, ["g"], [F.desc("n"), F.asc("v")], 5, F.col("v"), salt_buckets=7)
    got = got.toPandas().sort_values(["g", "rk"])
    want = (vc.sort_values(["g", "n", "v"], ascending=[True, False, True])
            .groupby("g").head(5))
    assert list(zip(got.g, got.v)) == list(zip(want.g, want.v))


def test_running_sums_match_cumsum(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"p": rng.choice(["a", "b"], 500), "s": rng.normal(size=500),
                        "w": rng.integers(1, 5, 500)})
    pdf = pdf.groupby(["p", "s"], as_index=False)["w"].sum()
    out = running_sums(spark.createDataFrame(pdf), "s", ["w"], ["p"], bucket_rows=60).toPandas()
    out = out.sort_values(["p", "s"])
    want = pdf.sort_values(["p", "s"]).groupby("p")["w"].cumsum() - pdf.sort_values(["p", "s"])["w"]
    assert list(out["cum_w"]) == list(want)


@pytest.mark.parametrize("width", [1_000_000, 3])
def test_previous_in_order_matches_lag(spark, width):
    rng = np.random.default_rng(4)
    seq = rng.permutation(400)
    pdf = pd.DataFrame({"k": rng.choice([1, 2, 3], 400, p=[0.8, 0.1, 0.1]),   # hot key
                        "seq": seq, "x": rng.integers(0, 1000, 400)})
    got = previous_in_order(spark.createDataFrame(pdf), ["k"], "seq", ["x"], bucket_width=width)
    got = got.toPandas().sort_values(["k", "seq"])
    want = pdf.sort_values(["k", "seq"]).groupby("k")["x"].shift(1)
    assert [None if pd.isna(v) else int(v) for v in got["prev_x"]] == \
        [None if pd.isna(v) else int(v) for v in want]


def test_column_quantiles_skip_missing(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"a": rng.normal(size=500), "b": rng.integers(0, 9, 500).astype(float), "c": np.nan})
    pdf.loc[::7, "a"] = np.nan
    got = column_quantiles(spark.createDataFrame(pdf), ["a", "b", "c"], [0.25, 0.5, 0.75])
    for c in ("a", "b"):
        for p in (0.25, 0.5, 0.75):
            assert got[(c, p)] == pytest.approx(pdf[c].quantile(p), rel=1e-12)
    assert got[("c", 0.5)] is None
