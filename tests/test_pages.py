"""Deep pages and running sums over range partitions, against a plain sort."""

import datetime as dt
import random

import pytest

from tabloom.functions import pages
from tabloom.functions.pages import page
from tabloom.operators import runlog


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(900):
        rows.append((i,
                     None if r.random() < .1 else r.choice(["", "a", "a\0", "abcdef", "abcdefg", "abcdefghijkl", "é" * 9, "z"]),
                     None if r.random() < .1 else r.choice([-2**63, -5, 0, 7, 2**32, 2**53 + 1, 2**53, 2**63 - 1]),
                     None if r.random() < .1 else r.choice([-0.0, 0.0, 1.5, float("nan"), float("inf"), float("-inf"), -1e300]),
                     start + dt.timedelta(microseconds=r.choice([0, 1, 2, 10**9])),
                     start.date() + dt.timedelta(days=r.randrange(3)), r.random() < .5))
    cols = "id int, `te``xt` string, big bigint, num double, ts timestamp, day date, flag boolean"
    return spark.createDataFrame(rows, cols).repartition(5).persist()


@pytest.mark.parametrize("order", [
    [("te`xt", False), ("id", False)], [("te`xt", True), ("id", True)], [("big", True), ("num", False), ("id", False)],
    [("num", True), ("big", False), ("id", True)], [("flag", False), ("day", True), ("ts", False), ("id", False)]])
def test_deep_page_equals_the_sorted_table(mixed, order):
    by = [mixed[f"`{c.replace('`', '``')}`"].desc() if d else mixed[f"`{c.replace('`', '``')}`"].asc() for c, d in order]
    ids = [r.id for r in mixed.orderBy(*by).collect()]
    for skip, limit in ((450, 9), (897, 10)):
        assert [r.id for r in page(mixed, order, skip, limit, deep=3).collect()] == ids[skip:skip + limit]


def test_beyond_the_end_and_empty(mixed):
    order = [("id", False)]
    assert page(mixed, order, 900, 5, deep=3).count() == 0 and page(mixed, order, 10**7, 5).count() == 0
    assert page(mixed.limit(0), order, 50, 5, deep=3).count() == 0
    with pytest.raises(ValueError):
        page(mixed, order, -1, 5)


def test_rows_that_agree_and_types_without_numbers(spark):
    df = spark.range(40).selectExpr("1 AS a", "CAST(id AS DECIMAL(30, 4)) AS d", "array(id) AS l")
    assert page(df, [("a", False)], 30, 20, deep=2).count() == 10
    assert [int(r.d) for r in page(df, [("a", False), ("d", True)], 30, 3, deep=2).collect()] == [9, 8, 7]
    assert [r.l for r in page(df, [("l", False)], 30, 2, deep=2).collect()] == [[30], [31]]


def test_few_rows_are_left_to_skip(mixed):
    fixed, rest = pages._locate(mixed, [("te`xt", False), ("id", False)], 700, 0)
    assert rest == 0 and len(fixed) >= 3
    plan = page(mixed, [("id", False)], 700, 5, deep=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Offset" not in plan and "> 700.0" in plan


def test_catalog_pages_go_deep(spark):
    n = 150_000
    cat = spark.range(n).selectExpr("CAST(id AS INT) AS dataset_id", "'x' AS name",
                                    "CASE WHEN id % 7 > 0 THEN timestamp_seconds(id DIV 10) END AS created_at")
    got = [r.dataset_id for r in runlog.page_newest(cat, skip=120_000, limit=5).collect()]
    want = sorted(range(n), key=lambda i: (i % 7 == 0, -(i // 10) if i % 7 else 0, i))[120_000:120_005]
    assert got == want


def test_times_without_a_zone_are_located(spark):
    r = random.Random(3)
    start = dt.datetime(2024, 3, 10, 1, 30)     # New York leaves out the hour from 2 o'clock
    times = [None if r.random() < .1 else start + dt.timedelta(microseconds=r.choice([0, 1, 3599 * 10**6, 3600 * 10**6, -10**15, -2 * 10**15 - 1]))
             for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, ts timestamp_ntz").repartition(4)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for down in (True, False):
            order = [("ts", down), ("id", False)]
            want = [x.id for x in df.orderBy(df.ts.desc() if down else df.ts.asc(), "id").collect()]
            assert pages._locate(df, order, 200, 2)[1] <= 2
            assert [x.id for x in page(df, order, 200, 9, deep=2).collect()] == want[200:209]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
