"""Report sections as data: one long table ``(section, row, item, value)``
unioned from earlier outputs. Layout (Markdown / HTML) is out of scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed order of the report's sections.
SUMMARY, OVERVIEW, QUALITY, CLEANING, FEATURES, TRAINING, LEADERBOARD, BEST, TIMELINE, APPENDIX = range(1, 11)


def section(number: int, df: DataFrame, item: Column, value: Column) -> DataFrame:
    """One part of the report: ``(section, item, value)`` from a small table."""
    return df.select(F.lit(number).alias("section"), item.cast("string").alias("item"),
                     value.cast("string").alias("value"))


def facts(spark, number: int, pairs: dict) -> DataFrame:
    """A part from known values."""
    rows = [(number, str(k), None if v is None else str(v)) for k, v in pairs.items()]
    return spark.createDataFrame(rows, "section INT, item STRING, value STRING")


def fields(number: int, df: DataFrame, columns: list[str]) -> DataFrame:
    """A part from the columns of a one-row table."""
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value"))
                               for c in columns]))
    return df.select(F.lit(number).alias("section"), pairs)


def report_sections(parts: list[DataFrame]) -> DataFrame:
    """Union ``(section, item, value)`` parts and number rows inside each
    section by item. Every part is a small summary (one row per column,
    model or count), so ordering inside a section is cheap."""
    allp = reduce(lambda a, b: a.unionByName(b), [
        p.select(F.col("section").cast("int"), F.col("item").cast("string"),
                 F.col("value").cast("string")) for p in parts])
    w = Window.partitionBy("section").orderBy("item")
    return allp.select("section", F.row_number().over(w).alias("row"), "item", "value")
