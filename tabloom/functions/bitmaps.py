"""Exact distinct counts of integral columns and dates by bitmaps.

A value sets one bit of the bitmap of its bucket (32,768 neighbouring values,
4 KB). A task sends at most one bitmap per bucket instead of one row per
distinct value, and no row is copied per column. That pays where values lie
dense, so ranges and approximate counts are looked at first, in one aggregate;
sparse columns (hashes, say) are left to a count of their values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import chunks, q, sql_lit

BITS = 32768            # values of a bucket: Spark's bitmap functions fix it
DENSE = 256             # distinct values a bucket must hold on average: 16 bytes each fill a bitmap's 4 KB
SMALL = 4               # buckets of a column that one aggregate without grouping holds

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _value(df: DataFrame, name: str) -> str:
    return f"CAST({f'unix_date({q(name)})' if isinstance(df.schema[name].dataType, T.DateType) else q(name)} AS BIGINT)"


def _bucket(v: int) -> int:
    return 1 + (v - 1) // BITS if v > 0 else -(-v // BITS)


def dense_ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int]]:
    """{column: (first, last bucket)} of the integral columns and dates whose values lie dense.

    Empty for fewer than two such columns: one count of distinct values copies
    no rows. A column without values has the range (0, 0).
    """
    whole = [c for c in columns if isinstance(df.schema[c].dataType, (*_INTEGRAL, T.DateType))]
    if len(whole) < 2:
        return {}
    out = {}
    for chunk in chunks(whole, 50):
        row = df.selectExpr(*[f"{f}({_value(df, c)}) AS {f[:3]}{i}" for i, c in enumerate(chunk)
                              for f in ("min", "max", "approx_count_distinct")]).first()
        for i, c in enumerate(chunk):
            if row[f"min{i}"] is None:
                out[c] = (0, 0)
                continue
            first, last = _bucket(row[f"min{i}"]), _bucket(row[f"max{i}"])
            if last - first < SMALL or row[f"app{i}"] >= DENSE * (last - first + 1):
                out[c] = (first, last)
    return out


def bitmap_cardinality(df: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """``(column, n_distinct)`` of the columns in ``ranges``, NULLs not counted.

    ``ranges`` must cover the values (see :func:`dense_ranges`). Columns of at
    most ``SMALL`` buckets share one aggregate; every other column has a scan
    of its own, which reads that column only, grouped by bucket.
    """
    parts = []
    small = [c for c, (first, last) in ranges.items() if last - first < SMALL]
    for chunk in chunks(small, 20) if small else []:
        counts = []
        for c in chunk:
            v = _value(df, c)
            maps = [f"bitmap_count(bitmap_construct_agg(bitmap_bit_position({v})) "
                    f"FILTER (WHERE bitmap_bucket_number({v}) = {b}L))" for b in range(ranges[c][0], ranges[c][1] + 1)]
            counts.append(f"named_struct('column', {sql_lit(c)}, 'n_distinct', {' + '.join(maps)})")
        parts.append(df.selectExpr(f"array({', '.join(counts)}) AS _d").selectExpr("inline(_d)"))
    for c in ranges.keys() - set(small):
        values = df.selectExpr(f"{_value(df, c)} AS v").where("v IS NOT NULL")
        maps = values.groupBy(F.expr("bitmap_bucket_number(v)").alias("b")).agg(
            F.expr("bitmap_construct_agg(bitmap_bit_position(v))").alias("m"))
        parts.append(maps.agg(F.expr("coalesce(sum(bitmap_count(m)), 0L)").alias("n_distinct"))
                     .select(F.lit(c).alias("column"), "n_distinct"))
    return union_all(parts)
