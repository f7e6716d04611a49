"""The steps of the report that read a whole table: how often, and how much of it."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabloom.functions import quantiles
from tabloom.operators import clean, encode, profile, select
from tabloom.sources.tables import dirty_lineitem


def test_features_of_few_values_share_a_pack():
    dummies, wide, part = [(0.0, 1.0, True)] * 24, (0.0, 500.0, True), (0.0, 1.0, False)
    layout = select._packs([wide, *dummies, part, (None, None, None), (3.0, 3.0, True)])
    assert len({x[0] for x in layout}) == 5         # three packs of eight dummies, two features of 32 bins
    for pack in {x[0] for x in layout}:
        assert np.prod([x[2] for x in layout if x[0] == pack]) <= select.PACK_CODES
    assert len({x[:2] for x in layout[1:25]}) == 24


@pytest.mark.parametrize("discrete", [True, False])
def test_packed_information_matches_counts_per_feature(spark, discrete):
    rng = np.random.default_rng(11)
    n = 700
    pdf = pd.DataFrame({f"d{i}": (rng.integers(0, 9, n) == i).astype(float) for i in range(9)})
    pdf["whole"] = rng.integers(-3, 4, n)                       # seven values, some below zero
    pdf["ends"] = rng.integers(0, 33, n).astype(float)          # 33 values in 32 bins
    pdf["last"] = rng.integers(100, 132, n).astype(float)       # 32 values
    pdf["part"] = rng.normal(size=n)
    pdf["gaps"] = np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 5, n))
    pdf["same"], pdf["half"] = 4.0, 0.5
    pdf["y"] = (pdf["whole"] > 0).astype(int) + (pdf["d3"] * rng.integers(0, 2, n)).astype(int)
    features = [c for c in pdf.columns if c != "y"]
    fill = {"gaps": float(pdf["gaps"].mean())}

    def bins(v):
        return np.zeros(n) if v.max() == v.min() else np.minimum(
            np.floor((v - v.min()) / (v.max() - v.min()) * select.BINS), select.BINS - 1)

    def information(a, b):
        p = pd.crosstab(a, b).to_numpy() / n
        q = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
        return float((p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum())
    df = spark.createDataFrame(pdf).repartition(3)
    got = {r["feature"]: r["mi"] for r in select.mutual_information(df, features, "y", discrete, fill=fill).collect()}
    y = pdf["y"] if discrete else bins(pdf["y"])
    assert set(got) == set(features)
    for c in features:
        assert got[c] == pytest.approx(max(information(bins(pdf[c].astype(float).fillna(fill.get(c, 0.0))), y), 0.0), abs=2e-6)


def test_codes_and_dummies_are_scaled_by_their_counts(spark, monkeypatch):
    rows = [("V%02d" % (i % 80) if i % 5 else None, "abc"[i % 3] if i % 7 else None, "nan" if i % 2 else None, "one",
             float(i), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "many STRING, few STRING, gap STRING, same STRING, x DOUBLE, y INT")
    seen, plain = [], encode.fit_scaler
    monkeypatch.setattr(encode, "fit_scaler", lambda d, c: seen.extend(c) or plain(d, c))
    fm = encode.fit_features(df, "y")
    assert seen == ["x"]            # before, every code and dummy was read too
    low, fm.low_variance = fm.low_variance, []
    encoded = fm.encode(df)
    want = plain(encoded, [c for c in encoded.columns if c != "y"])
    assert list(fm.scaler) == list(want) and len(want) == 4 + 50 and low == ["gap", "same"]
    for c, (m, s, n) in want.items():
        assert fm.scaler[c][2] == n and fm.scaler[c][:2] == pytest.approx((m, s), rel=1e-12, abs=1e-15)


def test_features_of_an_empty_table(spark):
    fm = encode.fit_features(spark.createDataFrame([], "c STRING, x DOUBLE, y INT"), "y")
    assert fm.scaler == {"c": (None, None, 0), "x": (None, None, 0)}


def test_later_quantile_passes_read_the_open_intervals_only(spark, monkeypatch):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"a": rng.uniform(1, 1e6, 4000), "b": rng.normal(size=4000), "c": np.full(4000, 7.0)})
    pdf.loc[::9, "a"] = np.nan
    read, plain = [], quantiles.long_form

    def counted(d, columns, *a):
        out = plain(d, columns, *a)
        read.append((columns, out.count()))
        return out
    monkeypatch.setattr(quantiles, "long_form", counted)
    got = quantiles.column_quantiles(spark.createDataFrame(pdf), ["a", "b", "c"], [0.25, 0.75])
    for c in ("a", "b", "c"):
        for p in (0.25, 0.75):
            assert got[(c, p)] == pytest.approx(pdf[c].quantile(p), rel=1e-12)
    assert read[0] == (["a", "b", "c"], 12000) and len(read) > 1
    assert all(columns == ["a", "b"] and n < 3000 for columns, n in read[1:])
    read.clear()
    monkeypatch.setattr(quantiles, "MAX_FILTERS", 0)        # too many intervals for a filter: the same values
    assert quantiles.column_quantiles(spark.createDataFrame(pdf), ["a", "b", "c"], [0.25, 0.75]) == got and len(read) == 1


def test_known_missing_counts_are_not_taken_again(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 4 else 1.0, "k" if i % 3 else None) for i in range(60)],
                               "a INT, sparse DOUBLE, t STRING")
    known = profile.missing_counts(df)
    counts = spark.createDataFrame([tuple(r) for r in known.collect()], known.schema)
    want = (sorted(map(tuple, profile.missing_report(df).collect())), profile.plan_profile(df, "t").collect(),
            clean.clean_table(df, "t").report)

    def again(_):
        raise AssertionError("counted again")
    monkeypatch.setattr(profile, "missing_counts", again)
    monkeypatch.setattr(clean, "missing_counts", again)
    assert (sorted(map(tuple, profile.missing_report(df, counts).collect())),
            profile.plan_profile(df, "t", counts=counts).collect(),
            clean.clean_table(df, "t", counts=counts).report) == want


def test_dirty_lines_read_the_table_once(spark, tmp_path):
    keys = [1, 97, 97, 194, None, 503, 11]
    spark.createDataFrame([(k, i, i, i + 1, 10.0 * i, 0.1, "R", "F") for i, k in enumerate(keys)], (
        "l_orderkey LONG, l_linenumber INT, l_partkey LONG, l_suppkey LONG, l_extendedprice DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING")).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    d = dirty_lineitem(spark, str(tmp_path))
    assert d.columns == ["l_orderkey", "l_linenumber", "price", "flag", "sparse", "target"]
    got = {r["l_linenumber"]: r["n"] for r in d.groupBy("l_linenumber").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: 2, 4: 1, 5: 1, 6: 1}
    assert len(d.inputFiles()) == 1
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
