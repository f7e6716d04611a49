"""The fast Gauss transform against the plain sum of kernels."""

import numpy as np
import pytest

from tabloom.operators import chartdata


def plain(x, points):
    x = np.asarray(x, float)
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = x.min() - np.ptp(x) / 2 + np.arange(points) * 2 * np.ptp(x) / (points - 1)
    return grid, np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))


def test_equals_the_plain_sum(spark):
    rng = np.random.default_rng(5)
    n = 3000
    data = {"normal": rng.normal(size=n), "tail": rng.standard_cauchy(n), "few": rng.integers(0, 4, n).astype(float),
            "far": 1e9 + rng.exponential(size=n), "tiny": 1e-12 * rng.random(n)}
    df = spark.createDataFrame(np.stack(list(data.values()), 1).tolist(), ", ".join(f"{c} double" for c in data)).repartition(3)
    got = chartdata.kde_curve(df, list(data), 60).toPandas()
    assert len(got) == 60 * len(data)
    for c, x in data.items():
        mine = got[got.column == c].sort_values("gi")
        grid, want = plain(x, 60)
        assert np.allclose(mine.x, grid, rtol=1e-12)
        assert np.abs(mine.density - want).max() <= 1e-9 * max(1.0, want.max()) if c != "far" else np.allclose(
            mine.density, want, rtol=1e-5, atol=1e-9)


def test_series_error_bound():
    terms = chartdata._hermite(chartdata.KDE_TERMS)
    t, s = np.linspace(-12, 12, 2001)[:, None], np.linspace(-0.25, 0.25, 41)
    total, fact = 0.0, 1.0
    for n, c in enumerate(terms):
        fact *= max(n, 1)
        total = total + sum(a * t ** j for j, a in enumerate(c)) * s ** n / fact
    assert np.abs(np.exp(-t * t / 2) * total - np.exp(-(t - s) ** 2 / 2)).max() < 2e-14 + 1e-15
    assert terms[4][:5] == [3, 0, -6, 0, 1]


@pytest.mark.parametrize("values", [[], [1.0], [2.0, 2.0, 2.0]])
def test_columns_without_spread_are_skipped(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "a double")
    assert chartdata.kde_curve(df, ["a"]).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(float(k),) for k in range(9)], "a double")
    plan = chartdata.kde_curve(df, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Cartesian" not in plan
