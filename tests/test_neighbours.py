"""Nearest-neighbour mutual information against a brute-force estimator."""

import math

import numpy as np
import pytest

from tabloom.operators import neighbours as nb


def psi(n):
    return -0.57721566490153286061 + sum(1 / k for k in range(1, int(n)))


def brute_class(x, labels, k=3):
    keep = [i for i, v in enumerate(labels) if labels.count(v) > 1]
    total = 0.0
    for i in keep:
        own = sorted(abs(x[j] - x[i]) for j in keep if labels[j] == labels[i] and j != i)
        near = min(k, len(own))
        m = sum(abs(x[j] - x[i]) < own[near - 1] for j in keep)
        total += psi(near) - psi(len(own) + 1) - psi(m)
    return max(0.0, psi(len(keep)) + total / len(keep)) if keep else 0.0


def brute_number(x, y, k=3):
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    both = np.maximum(dx, dy)
    np.fill_diagonal(both, np.inf)
    r = np.sort(both, axis=1)[:, min(k, len(x) - 1) - 1][:, None]
    nx, ny = (dx < r).sum(axis=1), (dy < r).sum(axis=1)
    return max(0.0, psi(len(x)) + psi(min(k, len(x) - 1)) - np.mean([psi(a) + psi(b) for a, b in zip(nx, ny)]))


def table(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n)
    b = rng.integers(0, 3, n).astype(float)             # many equal values
    c = rng.exponential(size=n) * 1e6
    y = a + 0.3 * b + 0.1 * rng.normal(size=n)
    label = [f"k{int(v > 0) + int(u)}" for v, u in zip(a, b)]
    label[0] = "alone"
    label[1] = None
    rows = [(float(p), float(q) if i % 50 else None, float(r), float(z) if i != 1 else None, s)
            for i, (p, q, r, z, s) in enumerate(zip(a, b, c, y, label))]
    return spark.createDataFrame(rows, "a double, `b b` double, c double, y double, label string").repartition(4)


def test_digamma():
    n = np.array([1, 2, 3, 9, 10, 11, 500, 10 ** 6])
    assert np.allclose(nb.digamma(n[:7]), [psi(k) for k in n[:7]], atol=1e-13)
    assert nb.digamma(n)[7] == pytest.approx(math.log(10 ** 6) - 0.5e-6, abs=1e-12)


@pytest.mark.parametrize("discrete,unit", [(True, 1 << 16), (False, 1 << 16), (False, 150)])
def test_equals_brute_force(spark, discrete, unit, monkeypatch):
    n, features = 2000, ["a", "b b", "c"]
    df, target = table(spark, n), "label" if discrete else "y"
    staged = {}
    plain = nb.scaled_rows
    monkeypatch.setattr(nb, "scaled_rows", lambda *a: staged.setdefault("rows", plain(*a)))
    got = nb.neighbour_information(df, features, target, discrete, digits=12, unit_rows=unit)
    rows = staged["rows"].toPandas()
    assert len(rows) == n - 1
    for j, c in enumerate(features):
        x = rows[f"x{j}"].to_numpy()
        assert len(set(x)) == len(x)                    # the noise tells all apart
        want = brute_class(x.tolist(), rows.y.tolist()) if discrete else brute_number(x, rows.y.to_numpy())
        assert got[c] == pytest.approx(want, abs=1e-9)
    assert got["a"] > got["c"]


def test_ends_are_exact():
    rng = np.random.default_rng(1)
    x, other = rng.normal(size=4000) * 10.0 ** rng.integers(-8, 8, 4000), rng.normal(size=4000)
    d = np.abs(x - other)
    lo, hi = nb._ends(x, d)
    assert (x - lo >= d).all() and (hi - x >= d).all()
    assert (x - np.nextafter(lo, np.inf) < d).all() and (np.nextafter(hi, -np.inf) - x < d).all()


def test_edges(spark):
    kind = "a double, y double, label string"
    empty = spark.createDataFrame([], kind)
    assert nb.neighbour_information(empty, ["a"], "y", False) == {"a": 0.0}
    assert nb.neighbour_information(empty, ["a"], "label", True) == {"a": 0.0}
    alone = spark.createDataFrame([(1.0, 2.0, "p"), (2.0, 3.0, "q")], kind)
    assert nb.neighbour_information(alone, ["a"], "label", True) == {"a": 0.0}
    assert nb.neighbour_information(alone, ["a"], "y", False)["a"] >= 0
    same = spark.createDataFrame([(5.0, float(k), "pq"[k % 2]) for k in range(40)], kind)      # a constant feature
    assert nb.neighbour_information(same, ["a"], "label", True)["a"] < 0.3
    # Infinite values are missing ones.
    rows = [(float(k % 7), float(k), "pq"[k % 2]) for k in range(40)]
    odd = spark.createDataFrame([*rows, (1.0, float("inf"), "p")], kind)
    assert nb.scaled_rows(odd, ["a"], "y", False).count() == 40
    assert math.isfinite(nb.neighbour_information(spark.createDataFrame([*rows, (float("-inf"), 1.0, "p")], kind),
                                                  ["a"], "label", True)["a"])


@pytest.mark.parametrize("discrete", [True, False])
def test_groups_are_freed_and_ends_beyond_the_index_are_counted(spark, discrete, monkeypatch):
    df, target = table(spark, 1500, 5), "label" if discrete else "y"
    features = ["a", "b b", "c"]
    want = nb.neighbour_information(df, features, target, discrete, digits=9)
    sorted_in, plain = [], nb._ranks
    monkeypatch.setattr(nb, "_ranks", lambda *a: sorted_in.append(1) or plain(*a))
    monkeypatch.setattr(nb, "EDGE_VALUES", 1)
    monkeypatch.setattr(nb, "GAPS", 1)
    monkeypatch.setattr(nb, "GROUP_ROWS", 1600)         # a feature at a time
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert nb.neighbour_information(df, features, target, discrete, digits=9) == pytest.approx(want, abs=1e-8)
    assert len(sorted_in) >= 3
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def brute_near(x, y, px, py, k, own):
    d = np.maximum(np.abs(x[:, None] - px), np.abs(y[:, None] - py))
    if own:
        np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("shape", ["even", "dummy", "rare", "copies", "tail", "flat"])
def test_plane_is_exact(shape):
    rng = np.random.default_rng(11)
    n = 1500
    x, y = rng.normal(size=n), np.sort(rng.normal(size=n))
    if shape in ("dummy", "rare"):
        x = (rng.random(n) < (0.2 if shape == "dummy" else 0.002)) * 5 + 1e-10 * rng.normal(size=n)
    if shape == "copies":
        x, y = np.repeat(x[:100], 15), np.repeat(y[:100], 15)
        x, y = x + 1e-10 * rng.normal(size=n), np.sort(y + 1e-10 * rng.normal(size=n))
    if shape == "tail":
        x = rng.standard_cauchy(n)
    if shape == "flat":
        y = np.sort(1e-10 * rng.normal(size=n))
    plane = nb.Plane(x, y)
    assert np.array_equal(plane.nearest(3), brute_near(x, y, x, y, 3, True))
    qx, qy = rng.normal(size=40), rng.normal(size=40)
    want = brute_near(qx, qy, x, y, 3, False)
    got = plane.within(qx, qy, np.where(np.arange(40) % 2, want[:, 2], np.inf), 3)
    assert np.array_equal(got, want)


def test_a_row_is_compared_with_few_others(monkeypatch):
    """Rows beside a row in the target only were not enough to bound the search: a row met hundreds of others."""
    rng = np.random.default_rng(12)
    n = 20_000
    plane = nb.Plane(rng.random(n), np.sort(rng.random(n)))
    seen, plain = [], np.partition
    monkeypatch.setattr(nb.np, "partition", lambda a, *r, **o: seen.append(a.size) or plain(a, *r, **o))
    plane.nearest(3)
    assert sum(seen) < 120 * n


@pytest.mark.parametrize("discrete", [True, False])
def test_rows_travel_in_blocks(spark, discrete, monkeypatch):
    """No shuffle of a row per value: what is kept has a row per block. Targets of many classes give the same."""
    df, target, features = table(spark, 1500, 9), "label" if discrete else "y", ["a", "b b", "c"]
    kept, plain = [], nb._Kept.__call__
    monkeypatch.setattr(nb._Kept, "__call__", lambda self, d: kept.append(plain(self, d).count()) or d)
    got = nb.neighbour_information(df, features, target, discrete, digits=9, unit_rows=200)
    assert kept and max(kept) < 1500
    if discrete:
        monkeypatch.setattr(nb, "MANY_HALOS", 0)
        assert nb.neighbour_information(df, features, target, discrete, digits=9) == pytest.approx(got, abs=1e-8)
        assert max(kept) > 4000
