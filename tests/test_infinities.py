"""Infinite values, wide tables and odd column names."""

import math
import time

import numpy as np
import pytest

from tabloom.operators import chartdata, encode, profile, select

INF = float("inf")


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float(a + b), "pq"[int(a > 0)]) for a, b in rng.normal(size=(40, 2))]
    kind = "x double, y double, z double, label string"
    odd = [(INF, 1.0, 2.0, "p"), (-INF, None, 1.0, "q"), (float("nan"), 0.5, 0.25, "p")]
    gone = [(None, *r[1:]) for r in odd]
    return spark.createDataFrame(rows + odd, kind), spark.createDataFrame(rows + gone, kind)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("operator", [
    lambda d: chartdata.histogram(d, ["x", "y"]), lambda d: chartdata.kde_curve(d, ["x", "y"]),
    lambda d: profile.correlation_matrix(d, ["x", "y", "z"]),
    lambda d: select.mutual_information(d, ["x", "y"], "label", True),
    lambda d: select.mutual_information(d, ["y", "z"], "x", False),
    lambda d: d.sparkSession.createDataFrame(list(encode.fit_scaler(d, ["x", "y"]).items()))])
def test_infinite_values_are_missing(tables, operator):
    with_inf, without = (rows(operator(d)) for d in tables)
    assert str(with_inf) == str(without)
    assert not any(isinstance(v, float) and not math.isfinite(v) for r in with_inf for v in r)


def test_scaling_leaves_finite_rows_finite(tables):
    got = encode.standard_scale(tables[0], ["x", "y"]).select("x").collect()
    assert sum(math.isfinite(r[0]) for r in got if r[0] is not None) == 40
    assert {r[0] for r in got if r[0] is not None and math.isinf(r[0])} == {INF, -INF}


def test_structure_report_of_a_wide_table(spark):
    rng = np.random.default_rng(4)
    names = [f"c`{k} x" if k % 10 == 0 else f"c{k}" for k in range(300)]
    df = spark.createDataFrame(rng.normal(size=(50, 300)).tolist(), ", ".join(f"`{n.replace('`', '``')}` double" for n in names))
    began = time.time()
    got = {r["column"]: r for r in profile.structure_report(df).collect()}
    assert set(got) == set(names) and all(r.n_distinct == 50 and r.n_bytes == 400 for r in got.values())
    print("seconds", time.time() - began)


def test_payload_bytes_of_odd_names(spark):
    df = spark.createDataFrame([(1, "ab"), (None, None)], "`a``b` int, `c.d` string")
    assert rows(profile.payload_bytes(df)) == [("a`b", 4), ("c.d", 2)]
