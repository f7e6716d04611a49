"""Pages of an ordered table, however deep.

``orderBy().offset().limit()`` keeps the best skip + limit rows of every
partition and merges them in one task, which is the table itself when the
skip is large. Here the first row of a deep page is located by counting: the
order is written as a sequence of numbers per row (a flag for nulls, then one
to a few exact doubles per column), and for one number after the other the
value at the wanted rank is found by radix counting among the rows that agree
so far. The rows before it are known by count and never move; the page is
taken from the rest, with at most ``DEEP`` rows to skip in any task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import q, sql_lit
from tabloom.functions.quantiles import select_ranks

DEEP = 100_000          # rows that a task may hold to skip them
CHUNK = 6               # bytes of a text in one number: 48 bits and 3 for their count fit a double

Order = list[tuple[str, bool]]      # (column, descending); nulls are the smallest values, as in Spark


def _halves(v: str) -> list[str]:
    return [f"CAST(shiftright({v}, 32) AS DOUBLE)", f"CAST({v} & 4294967295L AS DOUBLE)"]


def _numbers(c: str, dt: T.DataType) -> list[str] | None:
    """SQL of the doubles that order a value exactly; None for types without such a form."""
    if isinstance(dt, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType)):
        return [f"CAST(CAST({c} AS INT) AS DOUBLE)"]
    if isinstance(dt, T.DateType):
        return [f"CAST(unix_date({c}) AS DOUBLE)"]
    if isinstance(dt, T.LongType):
        return _halves(c)
    if isinstance(dt, T.TimestampType):
        return _halves(f"unix_micros({c})")
    if isinstance(dt, T.TimestampNTZType):      # by parts: a cast would pass through the session's time zone
        return [f"CAST(unix_date(CAST({c} AS DATE)) AS DOUBLE)",
                f"CAST((hour({c}) * 3600 + minute({c}) * 60) * 1000000L + CAST(extract(SECOND FROM {c}) * 1000000 AS BIGINT) AS DOUBLE)"]
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return [f"CASE WHEN isnan({c}) THEN 1D ELSE 0D END", f"CASE WHEN isnan({c}) THEN 0D ELSE CAST({c} AS DOUBLE) END"]
    if isinstance(dt, T.DecimalType) and dt.precision <= 15:
        return [f"CAST({c} AS DOUBLE)"]
    return None


def _keys(df: DataFrame, order: Order) -> Iterator[tuple[str, bool]]:
    """(SQL of a double, ends a text) in the order of the sort; stops before a type it cannot number.

    The receiver sends back True after a text's last chunk.
    """
    for name, descending in order:
        c, dt = q(name), df.schema[name].dataType
        sign = "-" if descending else ""
        numbers = _numbers(c, dt)
        text = type(dt) in (T.StringType, T.BinaryType) and getattr(dt, "collation", "UTF8_BINARY") == "UTF8_BINARY"
        if numbers is None and not text:
            return
        yield f"{sign}(CASE WHEN {c} IS NULL THEN 0D ELSE 1D END)", False
        for number in numbers or []:
            yield f"{sign}coalesce({number}, 0D)", False
        at, done = 1, not text
        while not done:
            piece = f"substring(CAST({c} AS BINARY), {at}, {CHUNK})"
            done = yield (f"{sign}coalesce(CAST(conv(rpad(hex({piece}), {2 * CHUNK}, '0'), 16, 10) AS DOUBLE) * 8 "
                          f"+ length({piece}), 0D)"), True
            at += CHUNK


def _locate(df: DataFrame, order: Order, skip: int, deep: int) -> tuple[list[tuple[str, float]], int] | None:
    """Numbers that the page's first row has, and the rows still to skip among those not before it; None beyond the end."""
    fixed: list[tuple[str, float]] = []
    alike = df
    keys = _keys(df, order)
    key = next(keys, None)
    while skip > deep and key is not None:
        number, chunk = key
        got = select_ranks(alike.select(F.lit("page").alias("g"), F.expr(number).alias("v")), {("page", skip)})
        if not got:
            return None
        value, below = got["page", skip]
        fixed.append((number, value))
        skip -= below
        alike = alike.where(f"{number} = {sql_lit(float(value))}")
        try:
            key = keys.send(chunk and abs(value) % 8 < CHUNK)
        except StopIteration:
            key = None
    return fixed, skip


def page(df: DataFrame, order: Order, skip: int, limit: int, deep: int = DEEP) -> DataFrame:
    """Rows ``skip`` to ``skip + limit`` of ``df`` in ``order``, a list of (column, descending).

    Nulls are the smallest values, NaN the largest number. Up to ``deep``
    skipped rows this is Spark's own offset. Beyond, ``df`` is read three or
    four times per number of the order that is needed (its order columns
    only, so a derived table should be persisted by its owner). A page beyond
    the end, or of an empty table, is empty. Rows that agree in the whole
    order may come in any order, as in any sort; more than ``deep`` of them,
    or of rows that agree up to a column whose type has no exact numbers
    (long decimals, nested types, other collations), are skipped by Spark's offset.
    """
    if skip < 0 or limit < 0:
        raise ValueError("skip and limit must not be negative")
    by = [F.desc(q(c)) if descending else F.asc(q(c)) for c, descending in order]
    if skip <= deep:
        return df.orderBy(*by).offset(skip).limit(limit)
    found = _locate(df, order, skip, deep)
    if found is None:
        return df.limit(0)
    fixed, skip = found
    reached = "true"
    for number, value in reversed(fixed):
        v = sql_lit(float(value))
        reached = f"({number} > {v} OR ({number} = {v} AND {reached}))"
    return df.where(reached).orderBy(*by).offset(skip).limit(limit)
