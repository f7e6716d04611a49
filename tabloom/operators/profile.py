"""Table profile: shape, missing values, cardinality, summary statistics,
top values, correlations, target summary and task-type detection.

Per-column statistics run as ONE job over an unpivoted (long-form) table
grouped by column name instead of one job per column; results come back
as small long-form DataFrames with one row per column (or per column and
value), so later steps join on ``column``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import (NUMERIC, chunks, col, column_labels, is_float_type,
                                       is_missing, long_form, q, sql_clean, sql_finite, sql_lit)
from tabloom.functions.bitmaps import bitmap_cardinality, dense_ranges, union_all
from tabloom.functions.heavy_hitters import top_counts
from tabloom.functions.quantiles import column_quantiles, quantiles_frame

# Fixed values of the reference behaviour.
CLASSIFICATION_MAX_DISTINCT = 20   # numeric target with <= 20 distinct -> classification
TOP_VALUES_K = 5
HIGH_MISSING_PCT = 50.0


def table_shape(df: DataFrame) -> DataFrame:
    """One row: ``n_rows BIGINT, n_cols INT``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("int"))


def column_types(df: DataFrame) -> DataFrame:
    """``(column, label)`` from the schema (boolean, datetime, numeric, categorical)."""
    spark = df.sparkSession
    return spark.createDataFrame(list(column_labels(df).items()), "column STRING, label STRING")


def missing_counts(df: DataFrame) -> DataFrame:
    """``(column, n_missing, n_rows)`` for every column, one pass over the table."""
    def miss(c):
        m = f"{q(c)} IS NULL" + (f" OR isnan({q(c)})" if is_float_type(df.schema[c].dataType) else "")
        return f"count_if({m})"
    arr = ", ".join(f"named_struct('column', {sql_lit(c)}, 'n_missing', {miss(c)})"
                    for c in df.columns)
    one = df.selectExpr("count(1) AS n_rows", f"array({arr}) AS _m")
    return one.selectExpr("inline(_m)", "n_rows")


def missing_report(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``(column, n_missing, pct)`` for columns with at least one gap; pct has 2 decimals.
    ``counts``, as of :func:`missing_counts`, may be passed in when already known."""
    m = missing_counts(df) if counts is None else counts
    return (m.where(F.col("n_missing") > 0)
             .select("column", "n_missing",
                     F.round(F.col("n_missing") / F.col("n_rows") * 100, 2).alias("pct")))


def high_missing_columns(df: DataFrame, pct_threshold: float = HIGH_MISSING_PCT) -> DataFrame:
    """Columns whose rounded missing percentage is above ``pct_threshold`` (report only)."""
    return missing_report(df).where(F.col("pct") > pct_threshold).select("column", "pct")


def cardinality(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, n_distinct)``: distinct non-missing values per column.

    Integral columns and dates whose values lie dense are counted by bitmaps
    (:func:`bitmap_cardinality`; their ranges take one aggregate now, when a
    table has two or more such columns). Several ``count(DISTINCT)`` of the
    others are planned by Spark as an Expand (one copy of each row per column,
    native types) and a two-level aggregation keyed by (column id, value):
    fully distributed, with the partial step collapsing repeated values
    before the shuffle.
    """
    columns = columns or df.columns
    parts = []
    ranges = dense_ranges(df, columns)
    if ranges:
        parts.append(bitmap_cardinality(df, ranges))
    rest = [c for c in columns if c not in ranges]
    for chunk in chunks(rest, 64) if rest else []:
        arr = ", ".join(f"named_struct('column', {sql_lit(c)}, 'n_distinct', "
                        f"CAST(count(DISTINCT {sql_clean(df, c)}) AS BIGINT))" for c in chunk)
        parts.append(df.selectExpr(f"array({arr}) AS _d").selectExpr("inline(_d)"))
    return union_all(parts)


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, n, mean, std, min, max)`` (unrounded) over
    non-missing values: one wide aggregate (chunked to stay within codegen
    limits) whose single row is unpivoted to one row per column."""
    parts = []
    for chunk in chunks(list(enumerate(columns)), 20):
        structs = []
        for i, c in chunk:
            v = f"CAST({sql_clean(df, c)} AS DOUBLE)"
            structs.append(f"named_struct('column', {sql_lit(c)}, 'n', count({v}), "
                           f"'mean', avg({v}), 'std', stddev_samp({v}), 'min', min({v}), "
                           f"'max', max({v}))")
        parts.append(df.selectExpr(f"array({', '.join(structs)}) AS _s").selectExpr("inline(_s)"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def medians(df: DataFrame, columns: list[str], probs: tuple[float, ...] = (0.5,),
            names: tuple[str, ...] = ("median",)) -> DataFrame:
    """Exact linear quantiles ``(column, <names>...)`` for numeric columns."""
    result = column_quantiles(df, columns, list(probs))
    for c in columns:
        for p in probs:
            result.setdefault((c, p), None)
    return quantiles_frame(df.sparkSession, result, dict(zip(probs, names)))


def numeric_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, mean, std, min, max, median)``; mean and std rounded to 4 decimals."""
    labels = column_labels(df)
    columns = columns or [c for c, t in labels.items() if t == NUMERIC]
    m = medians(df, columns)
    return (numeric_summary(df, columns).join(F.broadcast(m), "column")
             .select("column", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
                     "min", "max", "median"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, n)`` for non-missing values (values as text)."""
    long = long_form(df, columns, "string").where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = TOP_VALUES_K) -> DataFrame:
    """``(column, value, n, rk)``: k most frequent values per non-numeric column.

    Ties are broken by value (ascending) so the result is deterministic.
    """
    labels = column_labels(df)
    columns = columns or [c for c, t in labels.items() if t != NUMERIC]
    return top_counts(df, columns, k)


def _cross_products(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(i, j, n, sx, sy, sxx, syy, sxy)`` for i <= j over rows with both values.

    Each task folds its batches into p x p matrices of sums (values less the
    column's minimum, which keeps the sums small and constants at zero) and
    returns one row per pair; no data row is ever expanded.
    """
    lows = df.selectExpr(*[f"min({sql_finite(df, c)}) AS _m{i}" for i, c in enumerate(columns)]).first()
    base = [float(lows[f"_m{i}"] or 0.0) for i in range(len(columns))]
    names = ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"]

    def fold(batches):
        import numpy as np
        import pyarrow as pa
        p = len(base)
        n, sx, sxx, sxy = (np.zeros((p, p)) for _ in range(4))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns], 1) - base
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            n += m.T @ m
            sx += x.T @ m          # [i, j]: sum of column i where column j is there
            sxx += (x * x).T @ m
            sxy += x.T @ x
        i, j = np.triu_indices(p)
        out = [i, j, n[i, j], sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], sxy[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(a.astype("int32") if k < 2 else a) for k, a in enumerate(out)],
                                         names=names)
    wide = df.selectExpr(*[f"{sql_finite(df, c)} AS _x{i}" for i, c in enumerate(columns)])
    part = wide.mapInArrow(fold, "i INT, j INT, " + ", ".join(f"{c} DOUBLE" for c in names[2:]))
    return part.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names[2:]])


def correlation_matrix(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Pearson matrix in long form ``(col_a, col_b, corr)``, pairwise complete rows of finite values.

    ``corr`` is NULL where undefined (fewer than two pairs, or a column that
    is constant on them) instead of failing on a division by zero. One scan;
    a task sends p(p+1)/2 rows of sums. The upper triangle is then mirrored.
    """
    spark = df.sparkSession
    if len(columns) < 2:
        return spark.createDataFrame([], "col_a STRING, col_b STRING, corr DOUBLE")
    s = _cross_products(df, columns).where("n >= 2").selectExpr(
        "i", "j", "sxx - sx * sx / n AS vx", "syy - sy * sy / n AS vy", "sxy - sx * sy / n AS c", "sxx", "syy")
    # A variance within rounding of zero is that of a constant.
    r = s.where("vx > 1e-12 * sxx AND vy > 1e-12 * syy").select(
        "i", "j", F.round(F.when(F.col("i") == F.col("j"), 1.0).otherwise(
            F.col("c") / (F.sqrt("vx") * F.sqrt("vy"))), digits).alias("corr"))
    names = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(columns) for j, b in enumerate(columns)
                                   if i <= j], "i INT, j INT, col_a STRING, col_b STRING")
    upper = names.join(r, ["i", "j"], "left").select("col_a", "col_b", "corr")
    lower = upper.where(F.col("col_a") != F.col("col_b")).select(
        F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "corr")
    return upper.unionByName(lower)


def target_numeric_summary(df: DataFrame, target: str) -> DataFrame:
    """One row ``(mean, std, min, max, median)`` of a numeric target."""
    return numeric_stats(df, [target]).drop("column")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """``(class, n, pct)``; pct uses ALL rows (missing target included), 2 decimals.

    The denominator is the table's row count, so a target with very many
    distinct values never lands in one task.
    """
    grouped = (df.groupBy(F.when(is_missing(df, target), F.lit(None))
                          .otherwise(col(target).cast("string")).alias("class"))
               .agg(F.count(F.lit(1)).alias("n")))
    total = df.count()
    return (grouped.where(F.col("class").isNotNull())
            .select("class", "n", F.round(F.col("n") / F.lit(max(total, 1)) * 100, 2).alias("pct")))


def detect_task_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, task_type)``: non-numeric or <= 20 distinct -> classification."""
    labels = column_labels(df)
    columns = columns or df.columns
    card = cardinality(df, columns)
    lab = df.sparkSession.createDataFrame([(c, labels[c]) for c in columns],
                                          "column STRING, label STRING")
    return (card.join(F.broadcast(lab), "column")
            .select("column", F.when((F.col("label") != NUMERIC) |
                                     (F.col("n_distinct") <= CLASSIFICATION_MAX_DISTINCT),
                                     F.lit("classification"))
                    .otherwise(F.lit("regression")).alias("task_type")))


def detect_task_type(df: DataFrame, target: str) -> str:
    """Driver-side task type of one target (reads at most 21 distinct values)."""
    if column_labels(df)[target] != NUMERIC:
        return "classification"
    n = df.select(target).where(~is_missing(df, target)).distinct().limit(
        CLASSIFICATION_MAX_DISTINCT + 1).count()
    return "classification" if n <= CLASSIFICATION_MAX_DISTINCT else "regression"


def structure_report(df: DataFrame) -> DataFrame:
    """Per column: label, missing count, distinct count, numeric summary
    (mean, std rounded to 4 decimals; exact median), value bytes, and the
    most frequent values of the non-numeric columns.

    Missing counts and moments come from one aggregate per 20 columns, distinct counts from :func:`cardinality`
    (bitmaps where values lie dense), medians from radix passes over all columns.
    """
    labels = column_labels(df)
    numeric = [c for c, t in labels.items() if t == NUMERIC]
    structs = []
    for c in df.columns:
        v = sql_clean(df, c)
        miss = f"{q(c)} IS NULL" + (f" OR isnan({q(c)})" if is_float_type(df.schema[c].dataType)
                                    else "")
        if c in numeric:
            d = f"CAST({v} AS DOUBLE)"
            num = (f"avg({d}), 'std', stddev_samp({d}), 'min', min({d}), 'max', max({d})")
        else:
            num = ("CAST(NULL AS DOUBLE), 'std', CAST(NULL AS DOUBLE), 'min', CAST(NULL AS DOUBLE),"
                   " 'max', CAST(NULL AS DOUBLE)")
        structs.append(f"named_struct('column', {sql_lit(c)}, 'label', {sql_lit(labels[c])}, "
                       f"'n_missing', count_if({miss}), "
                       f"'mean', {num})")
    # Chunks of columns: one very wide aggregate takes longer to plan and compile than to run.
    stats = None
    for chunk in chunks(structs, 20):
        part = df.selectExpr(f"array({', '.join(chunk)}) AS _s").selectExpr("inline(_s)")
        stats = part if stats is None else stats.unionByName(part)
    med = medians(df, numeric) if numeric else \
        df.sparkSession.createDataFrame([], "column STRING, median DOUBLE")
    text = [c for c in df.columns if labels[c] != NUMERIC]
    top = (top_values(df, text) if text else df.sparkSession.createDataFrame([], "column STRING, value STRING, rk INT"))
    top = top.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "value"))),
                                                lambda t: t["value"]).alias("top"))
    return (stats.join(F.broadcast(med), "column", "left")      # one row per column in each
            .join(cardinality(df), "column").join(payload_bytes(df), "column").join(top, "column", "left")
            .selectExpr("column", "label", "n_missing", "n_distinct", "round(mean, 4) AS mean",
                        "round(std, 4) AS std", "min", "max", "median", "n_bytes", "top"))


# Fixed widths in bytes of the in-memory value of each type.
_FIXED_WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8,
                "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def payload_bytes(df: DataFrame) -> DataFrame:
    """``(column, n_bytes)``: value payload per column (fixed width, or text bytes)."""
    out = None
    for chunk in chunks(df.schema.fields, 50):
        structs = []
        for f in chunk:
            w = _FIXED_WIDTH.get(f.dataType.simpleString())
            size = f"count({q(f.name)}) * {w}" if w else f"sum(octet_length(CAST({q(f.name)} AS STRING)))"
            structs.append(f"named_struct('column', {sql_lit(f.name)}, 'n_bytes', CAST(coalesce({size}, 0) AS BIGINT))")
        part = df.selectExpr(f"array({', '.join(structs)}) AS _s").selectExpr("inline(_s)")
        out = part if out is None else out.unionByName(part)
    return out


# Fixed values of the reference behaviour: default models per task.
DEFAULT_MODELS = {"classification": ["random_forest", "logistic_regression", "xgboost"],
                  "regression": ["random_forest", "linear_regression", "xgboost"]}


# The stages a run goes through after planning, in order.
STEPS = ["eda", "cleaning", "feature_engineering", "training", "evaluation", "report"]


def plan_profile(df: DataFrame, target: str, task_type: str | None = None,
                 counts: DataFrame | None = None) -> DataFrame:
    """The planner's view of a table, one row: shape, task type, feature
    counts and lists, distinct target values, gaps, the models and the steps. ``task_type`` overrides detection;
    ``counts``, as of :func:`missing_counts`, may be passed in when already known."""
    labels = column_labels(df)
    task = task_type or detect_task_type(df, target)
    feats = [c for c in df.columns if c != target]
    counts = missing_counts(df) if counts is None else counts
    m = {r["column"]: (r["n_missing"], r["n_rows"]) for r in counts.collect()}
    n_rows = next(iter(m.values()))[1] if m else 0
    high = [c for c, (k, n) in m.items() if n and round(k / n * 100, 2) > HIGH_MISSING_PCT]
    numeric = [c for c in feats if labels[c] == NUMERIC]
    text = [c for c in feats if labels[c] == "categorical"]
    classes = cardinality(df, [target]).first()["n_distinct"]
    row = (n_rows, len(df.columns), task, len(feats), len(numeric), len(text), numeric, text, classes,
           any(k > 0 for k, _ in m.values()), len(high), sorted(high), DEFAULT_MODELS[task], STEPS)
    return df.sparkSession.createDataFrame([row], (
        "n_rows BIGINT, n_cols INT, task_type STRING, n_features INT, n_numeric INT, n_categorical INT, "
        "numeric_features ARRAY<STRING>, categorical_features ARRAY<STRING>, n_target_values BIGINT, "
        "has_missing BOOLEAN, n_high_missing INT, high_missing ARRAY<STRING>, models ARRAY<STRING>, "
        "steps ARRAY<STRING>"))


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows (1..100) in an explicit order, NaN / ±Inf as NULL."""
    from tabloom.functions.columns import finite_or_null
    if not 1 <= n <= 100:
        raise ValueError("n must be within 1..100")
    return df.orderBy(*order_by).limit(n).select(*[finite_or_null(df, c).alias(c)
                                                   for c in df.columns])
