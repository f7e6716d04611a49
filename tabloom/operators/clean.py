"""Cleaning: sparse-column drop, whole-row dedup, missing-target drop,
median / mode imputation and IQR clipping, in the reference's order.

Decisions that change the schema (which columns to drop, impute or clip)
need a few numbers per column; those come from one small aggregate each
and are the only things collected to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import (CATEGORICAL, NUMERIC, col, column_labels, is_float_type,
                                       is_missing, long_form, q, sql_clean, sql_lit)
from tabloom.functions.quantiles import column_quantiles
from tabloom.functions.ranking import top_k_per_group
from tabloom.operators.profile import missing_counts

# Fixed values of the reference behaviour.
DROP_MISSING_THRESHOLD = 0.60     # share of missing values above which a column is dropped
IQR_MULTIPLIER = 3.0
CONSTANT_FILL = "missing"         # categorical fill when a column has no value at all


def sparse_columns(df: DataFrame, threshold: float = DROP_MISSING_THRESHOLD, keep: tuple[str, ...] = (),
                   counts: DataFrame | None = None) -> list[str]:
    """Columns whose missing percentage, rounded to 2 decimals, exceeds ``threshold``.
    ``counts``, as of :func:`missing_counts`, may be passed in when already known."""
    rows = (missing_counts(df) if counts is None else counts).collect()          # one row per column
    out = []
    for r in rows:
        if r["column"] in keep or r["n_rows"] == 0 or r["n_missing"] == 0:
            continue
        pct = round(r["n_missing"] / r["n_rows"] * 100, 2)
        if pct / 100.0 > threshold:
            out.append(r["column"])
    order = {c: i for i, c in enumerate(df.columns)}
    return sorted(out, key=order.get)


def drop_sparse_columns(df: DataFrame, target: str | None = None,
                        threshold: float = DROP_MISSING_THRESHOLD) -> DataFrame:
    """Drop sparse columns; the target is never dropped."""
    cols = sparse_columns(df, threshold, keep=(target,) if target else ())
    return df.drop(*cols)


def dedup_rows(df: DataFrame) -> DataFrame:
    """Whole-row deduplication (hash aggregate with map-side combine, so a
    row repeated many times collapses before the shuffle)."""
    return df.dropDuplicates()


def duplicates_removed(df: DataFrame) -> DataFrame:
    """One row ``(n_before, n_after, duplicates_removed)`` from one job: rows
    are grouped on all columns (map-side combine), then the group sizes summed."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.sum("_n").cast("bigint").alias("n_before"),
                      F.count(F.lit(1)).alias("n_after")).select(
        "n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("duplicates_removed"))


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(~is_missing(df, target))


def column_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    q = column_quantiles(df, columns, [0.5])
    return {c: q.get((c, 0.5)) for c in columns}


def column_modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent value per column; ties go to the smallest value.

    Counts come from a distributed ``groupBy(column, value)``; the winner
    per column from a salted two-stage top-1, never a single-task map.
    """
    if not columns:
        return {}
    long = long_form(df, columns, "string").where(F.col("value").isNotNull())
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    top = top_k_per_group(vc, ["column"], [F.desc("n"), F.asc("value")], 1,
                          salt_on=F.col("value"))
    found = {r["column"]: r["value"] for r in top.collect()}   # one row per column
    return {c: found.get(c) for c in columns}


def impute_median(df: DataFrame, columns: list[str] | None = None,
                  gappy: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Fill gaps of numeric columns with their exact median (columns with
    gaps only). Filled columns become DOUBLE. Returns (table, {column: median}).
    ``gappy`` may be passed in when already known."""
    labels = column_labels(df)
    columns = columns if columns is not None else [c for c, t in labels.items() if t == NUMERIC]
    gappy = [c for c in gappy if c in columns] if gappy is not None else _gappy(df, columns)
    med = column_medians(df, gappy)
    out = df.selectExpr(*[f"coalesce(CAST({sql_clean(df, c)} AS DOUBLE), "
                          f"CAST({sql_lit(med[c])} AS DOUBLE)) AS {q(c)}"
                          if c in med else q(c) for c in df.columns])
    return out, med


def impute_mode(df: DataFrame, columns: list[str] | None = None,
                gappy: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Fill gaps of categorical columns with their mode (or ``"missing"``)."""
    labels = column_labels(df)
    columns = columns if columns is not None else [c for c, t in labels.items()
                                                   if t == CATEGORICAL]
    gappy = [c for c in gappy if c in columns] if gappy is not None else _gappy(df, columns)
    modes = {c: (m if m is not None else CONSTANT_FILL) for c, m in column_modes(df, gappy).items()}
    out = df.selectExpr(*[f"coalesce({q(c)}, {sql_lit(modes[c])}) AS {q(c)}" if c in modes
                          else q(c) for c in df.columns])
    return out, modes


def _miss_sql(df: DataFrame, c: str) -> str:
    return f"{q(c)} IS NULL" + (f" OR isnan({q(c)})" if is_float_type(df.schema[c].dataType)
                                else "")


def _gappy(df: DataFrame, columns: list[str]) -> list[str]:
    if not columns:
        return []
    row = df.selectExpr(*[f"max(CAST({_miss_sql(df, c)} AS INT)) AS _g{i}"
                          for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"_g{i}"]]


def quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, q1, q3, iqr)``: exact linear quartiles."""
    q = column_quantiles(df, columns, [0.25, 0.75])
    rows = [(c, q.get((c, 0.25)), q.get((c, 0.75)),
             None if q.get((c, 0.25)) is None else q[(c, 0.75)] - q[(c, 0.25)]) for c in columns]
    return df.sparkSession.createDataFrame(rows, "column STRING, q1 DOUBLE, q3 DOUBLE, iqr DOUBLE")


def iqr_bounds(df: DataFrame, columns: list[str], k: float = IQR_MULTIPLIER) -> DataFrame:
    """``(column, lower, upper, n_outside)`` for columns with a non-zero IQR; missing values are not outside."""
    qs = [r for r in quartiles(df, columns).collect() if r["iqr"] not in (None, 0.0)]
    if not qs:
        return df.sparkSession.createDataFrame(
            [], "column STRING, lower DOUBLE, upper DOUBLE, n_outside BIGINT")
    bounds = {r["column"]: (r["q1"] - k * r["iqr"], r["q3"] + k * r["iqr"]) for r in qs}
    counts = df.selectExpr(*[f"count_if({sql_clean(df, c)} < {sql_lit(float(lo))} OR {sql_clean(df, c)} > "
                             f"{sql_lit(float(hi))}) AS _n{i}"
                             for i, (c, (lo, hi)) in enumerate(bounds.items())]).first()
    rows = [(c, lo, hi, counts[f"_n{i}"]) for i, (c, (lo, hi)) in enumerate(bounds.items())]
    return df.sparkSession.createDataFrame(
        rows, "column STRING, lower DOUBLE, upper DOUBLE, n_outside BIGINT")


def outlier_count(df: DataFrame, columns: list[str], k: float = IQR_MULTIPLIER) -> DataFrame:
    """``(column, n_outliers)`` outside ``[q1 - k·iqr, q3 + k·iqr]``."""
    b = iqr_bounds(df, columns, k)
    return b.select("column", F.col("n_outside").alias("n_outliers"))


def clip_columns(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Clip each column to its bounds; missing values (NULL, NaN) stay as they are."""
    def clip(c):
        lo, hi = bounds[c]
        return (f"CASE WHEN {_miss_sql(df, c)} THEN {q(c)} ELSE "
                f"greatest(least({q(c)}, {sql_lit(float(hi))}), {sql_lit(float(lo))}) END AS {q(c)}")
    return df.selectExpr(*[clip(c) if c in bounds else q(c) for c in df.columns])


def iqr_clip(df: DataFrame, columns: list[str], k: float = IQR_MULTIPLIER) -> tuple[DataFrame, DataFrame]:
    """Clip columns with values outside the IQR fence.

    Returns (clipped table, ``(column, lower, upper, n_clipped)`` with
    bounds rounded to 4 decimals, for clipped columns only).
    """
    b = iqr_bounds(df, columns, k).where(F.col("n_outside") > 0).collect()
    clipped = clip_columns(df, {r["column"]: (r["lower"], r["upper"]) for r in b})
    report = df.sparkSession.createDataFrame(
        [(r["column"], round(r["lower"], 4), round(r["upper"], 4), r["n_outside"]) for r in b],
        "column STRING, lower DOUBLE, upper DOUBLE, n_clipped BIGINT")
    return clipped, report


@dataclass
class CleanResult:
    table: DataFrame
    report: dict
    clip_bounds: DataFrame
    medians: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    held: DataFrame | None = None

    def release(self) -> None:
        """Drop the persisted deduplicated rows once ``table`` is no longer read."""
        if self.held is not None:
            self.held.unpersist()


def clean_table(df: DataFrame, target: str | None, threshold: float = DROP_MISSING_THRESHOLD,
                iqr_multiplier: float = IQR_MULTIPLIER, clip_outliers: bool = True,
                impute_missing: bool = True, key_col: str | None = None,
                counts: DataFrame | None = None) -> CleanResult:
    """The whole cleaning stage. The deduplicated rows are persisted because
    imputation and clipping read them several times; the owner of the result
    calls ``release()``. ``key_col`` adds a key made from the deduplicated
    row, before any value is filled or clipped, so that it is unique. ``counts``
    are the table's missing counts, when already known."""
    labels_before = column_labels(df)
    cols_before = list(df.columns)
    keep = (target,) if target else ()
    dropped = sparse_columns(df, threshold, keep=keep, counts=counts)
    work = df.drop(*dropped)

    # ONE shuffle deduplicates and counts: rows grouped on every column
    # (map-side combined) give rows before (sum of group sizes), rows after
    # (number of groups) and deduplicated rows with a missing target; the
    # persisted groups are then the deduplicated table itself.
    has_target = bool(target) and target in work.columns
    groups = (work.groupBy(*[col(c) for c in work.columns])
              .agg(F.count(F.lit(1)).alias("_n"))
              .persist(StorageLevel.MEMORY_AND_DISK))
    counts = groups.agg(F.sum("_n").alias("rows_before"), F.count(F.lit(1)).alias("n"),
                        (F.count_if(is_missing(work, target)) if has_target
                         else F.lit(0)).alias("n_null_target")).first()
    rows_before = counts["rows_before"] or 0
    dup_removed = rows_before - counts["n"]
    target_dropped = counts["n_null_target"]
    deduped = groups.drop("_n")
    base = drop_null_target(deduped, target) if has_target else deduped

    labels = column_labels(base)
    numeric = [c for c, t in labels.items() if t == NUMERIC]
    categorical = [c for c, t in labels.items() if t == CATEGORICAL]
    gappy = _gappy(base, base.columns)
    if key_col:
        base = base.withColumn(key_col, F.sha2(F.to_json(F.struct(*[col(c) for c in base.columns]),
                                                         {"ignoreNullFields": "false"}), 256))
    medians, modes = {}, {}
    out = base
    if impute_missing:
        out, medians = impute_median(out, numeric, gappy)
        out, modes = impute_mode(out, categorical, gappy)
    bounds_df = df.sparkSession.createDataFrame(
        [], "column STRING, lower DOUBLE, upper DOUBLE, n_clipped BIGINT")
    if clip_outliers:
        out, bounds_df = iqr_clip(out, [c for c in numeric if c != target], iqr_multiplier)
    bounds_rows = bounds_df.collect()
    rows_after = rows_before - dup_removed - target_dropped
    report = {
        "rows_before": rows_before, "rows_after": rows_after,
        "rows_dropped": rows_before - rows_after, "duplicates_removed": dup_removed,
        "target_missing_dropped": target_dropped, "columns_before": cols_before,
        "columns_after": [c for c in out.columns if c != key_col], "columns_dropped": dropped,
        "columns_imputed_numeric": list(medians), "columns_imputed_categorical": list(modes),
        "columns_clipped": [r["column"] for r in bounds_rows],
        "clip_bounds": {r["column"]: {"lower": r["lower"], "upper": r["upper"],
                                      "n_clipped": r["n_clipped"]} for r in bounds_rows},
        "drop_missing_threshold": threshold, "iqr_multiplier": iqr_multiplier,
        "imputation_strategy": {"numeric": "median", "categorical": "mode_or_constant"},
        "column_labels": labels_before,
    }
    return CleanResult(out, report, bounds_df, medians, modes, groups)


def cleaning_report_frame(spark, report: dict) -> DataFrame:
    """The whole report as one row: counts, column lists, settings, and the bounds
    (4 decimals) and number of values of the clipped columns, in the order of ``columns_clipped``."""
    clipped = sorted(report["columns_clipped"])
    bounds = [report["clip_bounds"][c] for c in clipped]
    strategy = report["imputation_strategy"]
    return spark.createDataFrame(
        [(report["rows_before"], report["rows_after"], report["rows_dropped"],
          report["duplicates_removed"], report["target_missing_dropped"],
          report["columns_before"], report["columns_after"],
          report["columns_dropped"], report["columns_imputed_numeric"],
          report["columns_imputed_categorical"], clipped,
          [round(float(b["lower"]), 4) for b in bounds], [round(float(b["upper"]), 4) for b in bounds],
          [b["n_clipped"] for b in bounds], float(report["drop_missing_threshold"]), float(report["iqr_multiplier"]),
          strategy["numeric"], strategy["categorical"])],
        "rows_before BIGINT, rows_after BIGINT, rows_dropped BIGINT, duplicates_removed BIGINT, "
        "target_missing_dropped BIGINT, columns_before ARRAY<STRING>, columns_after ARRAY<STRING>, "
        "columns_dropped ARRAY<STRING>, "
        "columns_imputed_numeric ARRAY<STRING>, columns_imputed_categorical ARRAY<STRING>, "
        "columns_clipped ARRAY<STRING>, clip_lower ARRAY<DOUBLE>, clip_upper ARRAY<DOUBLE>, clip_n ARRAY<BIGINT>, "
        "drop_missing_threshold DOUBLE, iqr_multiplier DOUBLE, imputation_numeric STRING, imputation_categorical STRING")
