"""Most frequent values by bounded summaries, against a full count."""

from collections import Counter

import numpy as np
import pytest

from tabloom.functions import heavy_hitters as hh


def brute(columns, rows, k):
    out = []
    for i, c in enumerate(columns):
        found = Counter(r[i] for r in rows if r[i] is not None)
        ranked = sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))[:k]
        out += [(c, v, n, rk) for rk, (v, n) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(2)
    n = 6000
    heavy = [f"h{z}" if z < 12 else f"u{i}" for i, z in enumerate(rng.zipf(1.4, n))]   # few common, many lone values
    alike = [f"v{rng.integers(0, 3000)}" for _ in range(n)]                            # no proof possible
    few = [None if rng.random() < 0.1 else "éa b"[rng.integers(0, 4)] for _ in range(n)]
    rows = list(zip(heavy, alike, few, [None] * n))
    return rows, spark.createDataFrame(rows, "heavy string, `al``ike` string, few string, none string").repartition(5)


@pytest.mark.parametrize("capacity,recounted", [(1024, 4096), (40, 4096), (40, 20), (5, 5), (100_000, 10)])
def test_equals_a_full_count(skewed, capacity, recounted):
    rows, df = skewed
    for k in (5, 20):
        got = hh.top_counts(df, df.columns, k, capacity, max(k, recounted))
        assert sorted(map(tuple, got.collect())) == brute(df.columns, rows, k)


def test_summaries_are_small_and_bound_the_counts(skewed):
    rows, df = skewed
    found = hh.summaries(df, ["heavy"], 40).collect()
    cut = next(r.n for r in found if r.value is None)
    assert len(found) <= 40 * df.rdd.getNumPartitions() + 1 < len({r[0] for r in rows})
    low = {r.value: r.n for r in found if r.value is not None}
    for v, n in Counter(r[0] for r in rows).items():
        assert low.get(v, 0) <= n <= low.get(v, 0) + cut


def test_no_full_count_where_the_top_is_proven(skewed, monkeypatch):
    _, df = skewed
    monkeypatch.setattr(hh, "top_k_per_group", lambda d, g, *a, f=hh.top_k_per_group: f(d, g, *a) if g == ["c"] else 1 / 0)
    assert hh.top_counts(df, ["heavy"], 5, 200).count() == 5
    with pytest.raises(ZeroDivisionError):
        hh.top_counts(df, ["al`ike"], 5, 40)


def test_empty(spark):
    empty = spark.createDataFrame([], "a string")
    assert hh.top_counts(empty, ["a"], 5).count() == 0 and hh.top_counts(empty, [], 5).count() == 0
