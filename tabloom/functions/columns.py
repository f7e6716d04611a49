"""Column classification, missing-value tests and scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"
DATETIME = "datetime"
BOOLEAN = "boolean"


def type_label(dt: T.DataType) -> str:
    """Label of a Spark type, tested in the order boolean, datetime, numeric."""
    if isinstance(dt, T.BooleanType):
        return BOOLEAN
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATETIME
    if isinstance(dt, T.NumericType):
        return NUMERIC
    return CATEGORICAL


def column_labels(df: DataFrame) -> dict[str, str]:
    """Schema walk: column name -> label (no job is run)."""
    return {f.name: type_label(f.dataType) for f in df.schema.fields}


def q(name: str) -> str:
    """Back-quote a column name for use in SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def is_float_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DoubleType, T.FloatType))


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN for floating columns (one notion of missing)."""
    c = col(name)
    if is_float_type(df.schema[name].dataType):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def clean_value(df: DataFrame, name: str) -> Column:
    """Column value with NaN turned into NULL for floating columns."""
    c = col(name)
    if is_float_type(df.schema[name].dataType):
        return F.nanvl(c, F.lit(None).cast(df.schema[name].dataType))
    return c


def finite_or_null(df: DataFrame, name: str) -> Column:
    """NaN, +Inf and -Inf become NULL (JSON-safe value)."""
    c = col(name)
    if is_float_type(df.schema[name].dataType):
        bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
        return F.when(bad, F.lit(None)).otherwise(c)
    return c


def as_double(df: DataFrame, name: str) -> Column:
    """Feature value as DOUBLE; booleans become 0/1, NaN becomes NULL."""
    dt = df.schema[name].dataType
    c = col(name)
    if isinstance(dt, T.BooleanType):
        return c.cast("int").cast("double")
    return clean_value(df, name).cast("double")


def safe_identifier(c: Column, max_len: int = 60) -> Column:
    """Keep letters, digits, '-' and '_'; anything else becomes '_'; cut at max_len."""
    return F.substring(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_"), 1, max_len)


def chunks(items: list, size: int) -> list[list]:
    """Split a long expression list so one aggregate stays within codegen limits."""
    return [items[i:i + size] for i in range(0, len(items), size)] or [[]]


def long_form(df: DataFrame, columns: list[str], value_type: str = "double",
              ids: list[str] | None = None, clean: bool = True, finite: bool = False) -> DataFrame:
    """Unpivot ``columns`` into rows ``(ids..., column, value)``.

    With ``finite`` infinite values are NULL too. Values are cast to ``value_type`` (NaN -> NULL first when ``clean``), so
    one aggregate grouped by ``column`` replaces one job per column. The
    unpivot is a single Expand inside whole-stage codegen.
    """
    ids = ids or []
    text = (lambda c: sql_finite(df, c)) if finite else (lambda c: sql_clean(df, c) if clean else q(c))
    vals = [f"CAST({text(c)} AS {value_type}) AS _v{i}"
            for i, c in enumerate(columns)]
    wide = df.selectExpr(*[q(i) for i in ids], *vals)
    out = wide.unpivot(ids or [], [f"_v{i}" for i in range(len(columns))], "_slot", "value")
    names = ", ".join(f"'_v{i}', {sql_lit(c)}" for i, c in enumerate(columns))
    return out.selectExpr(*[q(i) for i in ids], f"map({names})[_slot] AS column", "value")


def sql_lit(v) -> str:
    """Render a Python value as a Spark SQL literal (doubles get the D suffix)."""
    import math
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return f"{v}L"
    if isinstance(v, float):
        if math.isnan(v):
            return "CAST('NaN' AS DOUBLE)"
        if math.isinf(v):
            return "CAST('Infinity' AS DOUBLE)" if v > 0 else "CAST('-Infinity' AS DOUBLE)"
        return f"({v!r}D)"
    s = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{s}'"


def sql_clean(df: DataFrame, name: str) -> str:
    """SQL text of :func:`clean_value` (NaN -> NULL for floating columns)."""
    if is_float_type(df.schema[name].dataType):
        return f"nanvl({q(name)}, CAST(NULL AS {df.schema[name].dataType.simpleString()}))"
    return q(name)


def sql_finite(df: DataFrame, name: str) -> str:
    """SQL text of the value as DOUBLE; NaN and infinite values are missing (NULL).

    The rule of all sums, ranges and scales: one infinite value would spoil
    the whole column. Order statistics keep infinite values, as their ends.
    """
    if not is_float_type(df.schema[name].dataType):
        return sql_double(df, name)
    return f"CASE WHEN abs({q(name)}) < double('infinity') THEN CAST({q(name)} AS DOUBLE) END"


def sql_double(df: DataFrame, name: str) -> str:
    """SQL text of :func:`as_double`."""
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return f"CAST(CAST({q(name)} AS INT) AS DOUBLE)"
    return f"CAST({sql_clean(df, name)} AS DOUBLE)"
