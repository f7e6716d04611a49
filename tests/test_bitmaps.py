"""Distinct counts by bitmaps, against a plain count."""

import random

import pytest

from tabloom.functions import bitmaps
from tabloom.operators import profile
from tabloom.operators.profile import cardinality
from tabloom.sources.tables import load
from conftest import SF0001


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def numbers(spark):
    r = random.Random(3)
    rows = [(r.randrange(-3, 4), r.randrange(-70_000, 70_000), r.choice([-2**63, 2**63 - 1, 0, None, 32768, -32768]),
             r.randrange(-40_000, 90_000) if r.random() < .9 else None, None, r.getrandbits(40), str(r.randrange(9)))
            for _ in range(5000)]
    cols = "tiny tinyint, wide int, ends bigint, `ga``ps` int, none int, sparse bigint, text string"
    return rows, spark.createDataFrame(rows, cols).repartition(6)


def test_equals_a_plain_count(numbers):
    rows, df = numbers
    want = {c: len({r[i] for r in rows} - {None}) for i, c in enumerate(df.columns)}
    assert {r.column: r.n_distinct for r in cardinality(df).collect()} == want


@pytest.mark.parametrize("c", ["tiny", "wide", "ga`ps", "none"])
def test_grouped_buckets(numbers, monkeypatch, c):
    rows, df = numbers
    monkeypatch.setattr(bitmaps, "SMALL", 0)
    monkeypatch.setattr(bitmaps, "DENSE", 0)
    got = bitmaps.bitmap_cardinality(df, {c: bitmaps.dense_ranges(df, df.columns)[c]}).first()
    assert tuple(got) == (c, len({r[df.columns.index(c)] for r in rows} - {None}))


def test_which_columns_lie_dense(numbers):
    _, df = numbers
    found = bitmaps.dense_ranges(df, df.columns)
    assert set(found) == {"tiny", "wide", "ga`ps", "none"} and found["none"] == (0, 0)
    assert found["tiny"] == (0, 1) and found["wide"][0] == -2 and found["wide"][1] == 3
    assert bitmaps.dense_ranges(df, ["wide", "text"]) == {}


def test_no_row_is_copied_for_dense_columns(spark):
    items = load(spark, SF0001, "lineitem").selectExpr("l_orderkey", "l_partkey", "l_linenumber", "CAST(l_shipdate AS DATE) AS d")
    got = cardinality(items)
    assert "Expand" not in plan(got) and "bitmap" in plan(got).lower()
    want = items.selectExpr(*[f"count(DISTINCT {c}) AS {c}" for c in items.columns]).first().asDict()
    assert {r.column: r.n_distinct for r in got.collect()} == want


def test_empty_table(spark):
    got = cardinality(spark.createDataFrame([], "a int, b bigint, c string"))
    assert {r.column: r.n_distinct for r in got.collect()} == {"a": 0, "b": 0, "c": 0}


def test_structure_report_copies_no_rows_for_dense_columns(spark):
    df = spark.range(4000).selectExpr("CAST(id AS INT) AS a", "id % 7 AS b", "CASE WHEN id > 9 THEN id DIV 2 END AS c")
    report = profile.structure_report(df)
    assert "Expand" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert {r["column"]: r["n_distinct"] for r in report.collect()} == {"a": 4000, "b": 7, "c": 1995}
