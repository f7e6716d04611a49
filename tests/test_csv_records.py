"""CSV files with quoted newlines, split among tasks, against Spark's whole-file parse."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tabloom.sources import csv_ingest, csv_records

CELLS = ["plain", "", 'with "quotes"', "two\nlines", "a,b", "\n", "three\n\nlines, \"q\"", "crlf\r\ninside", "é ü", '"', "x" * 90,
         "tail ", " lead", "12"]


def cell(v):
    return '"' + v.replace('"', '""') + '"' if any(c in v for c in '",\n\r') else v


def write(folder, name, rows, ending="\n", header="a,b,c"):
    with open(os.path.join(folder, name), "w", newline="", encoding="utf-8") as f:
        f.write(header + ending + ending.join(",".join(map(cell, r)) for r in rows) + ending)


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "211b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_equals_the_whole_file_parse(spark, small_splits, ending):
    rng = random.Random(7)
    folder = tempfile.mkdtemp(prefix="tabloom-c-")
    for k in range(2):
        rows = [[rng.choice(CELLS[2:]) for _ in range(3)] for _ in range(150)]
        rows[40][1] = "long\n" * 200 + "end"            # spans several splits
        rows[90][2] = "no quote marks here but newlines\n" * 40
        write(folder, f"f{k}.csv", rows, ending)
    lines = csv_records._lines(spark, folder, "UTF-8")
    assert lines.select("file", "at").distinct().count() > 40
    assert lines.rdd.getNumPartitions() > 20
    got, header = csv_ingest.read_text_table(spark, folder, "UTF-8")
    whole = (spark.read.option("header", True).option("multiLine", True).options(**csv_ingest.CSV_OPTIONS)
             .option("nullValue", "\u0000").option("emptyValue", "").csv(folder))
    na = F.array(*map(F.lit, csv_ingest.NA_TOKENS))
    whole = whole.select(*[F.when(~F.array_contains(na, F.col(c)), F.col(c)).alias(c) for c in whole.columns])
    assert header == whole.columns == ["a", "b", "c"]
    # Spark reads CR LF inside a field as LF if it ends the lines too; here the field stays as written.
    key = lambda r: tuple((x or "").replace("\r\n", "\n") for x in r)
    got_rows = got.cache().select(*header).collect()
    assert sorted(map(key, got_rows)) == sorted(map(key, whole.collect())) and len(got_rows) == 300
    assert any("crlf\r\ninside" in tuple(r) for r in got_rows)


@pytest.mark.parametrize("line,inside,want", [
    ('a,b', False, False), ('a,"b', False, True), ('a,"b""', False, True), ('a,"b"""', False, False), ('5" pipe,x', False, False),
    ('x"', True, False), ('x",y', True, False), ('x","y', True, True), ('x""', True, True), ('x', True, True), ('"",""', False, False),
    ('"a"x,"b', False, True), ('x"y,z', True, False), ('', True, True), (',', False, False), ('"', False, True), ('"', True, False)])
def test_states(line, inside, want):
    assert csv_records.open_after(line, inside) is want


def test_ingest_with_quoted_newlines(spark, small_splits):
    folder = tempfile.mkdtemp(prefix="tabloom-c-")
    with open(os.path.join(folder, "t.csv"), "w", newline="") as f:
        f.write('n,note\n1,"two\nlines"\n\n2,"x"\n3,ok,extra\n4,NA\n5,"open\nto the end')
    got = csv_ingest.ingest_csv(spark, folder)
    assert got.types == {"n": "bigint", "note": "string"}
    assert sorted(map(tuple, got.table.collect())) == [(1, "two\nlines"), (2, "x"), (4, None), (5, "open\nto the end")]
    assert [r[0] for r in got.quarantine.collect()] == ["3,ok,extra"]
    got.release()


def test_latin_1_records(spark):
    folder = tempfile.mkdtemp(prefix="tabloom-c-")
    with open(os.path.join(folder, "t.csv"), "wb") as f:
        f.write('n,note\n1,"café\nbär"\n'.encode("latin-1"))
    enc = csv_ingest.choose_encoding(spark, folder)
    text, _ = csv_ingest.read_text_table(spark, folder, enc)
    assert [tuple(r)[:2] for r in text.cache().collect()] == [("1", "café\nbär")]
