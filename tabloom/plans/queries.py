"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

Each query applies one library operator to whole driver tables (or inputs
Spark derives from them). Float outputs are rounded to 4 decimals here,
and in the matching SQL oracle, so value hashes are stable.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import pages
from tabloom.functions.columns import col
from tabloom.operators import (chartdata, clean, encode, metrics, profile, rank, report,
                               select, models,
                               runlog, split)
from tabloom.operators.runstore import RunStore
from tabloom.session import cut_lineage, ensure_checkpoint_dir
from tabloom.sources import csv_ingest
from tabloom.sources.tables import (binary_predictions, dirty_lineitem, load,
                                    multiclass_predictions, order_features,
                                    regression_predictions, run_events, datasets,
                                    dataset_patches, document_features)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]


def register(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


def round_floats(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                       else col(f.name) for f in df.schema.fields])


# ── profile ──────────────────────────────────────────────────────────────────

@register("table_shape")
def q_table_shape(spark, sf):
    return profile.table_shape(load(spark, sf, "lineitem"))


@register("missing_report")
def q_missing_report(spark, sf):
    return profile.missing_report(dirty_lineitem(spark, sf))


@register("high_missing_columns")
def q_high_missing_columns(spark, sf):
    return profile.high_missing_columns(dirty_lineitem(spark, sf))


@register("cardinality")
def q_cardinality(spark, sf):
    return profile.cardinality(load(spark, sf, "lineitem"))


@register("numeric_stats")
def q_numeric_stats(spark, sf):
    return round_floats(profile.numeric_stats(load(spark, sf, "lineitem"), LINEITEM_NUMERIC))


@register("top_values")
def q_top_values(spark, sf):
    return profile.top_values(load(spark, sf, "lineitem"))


@register("correlation_matrix")
def q_correlation_matrix(spark, sf):
    return profile.correlation_matrix(load(spark, sf, "lineitem"), LINEITEM_NUMERIC)


@register("target_numeric_summary")
def q_target_numeric_summary(spark, sf):
    return round_floats(profile.target_numeric_summary(load(spark, sf, "orders"), "o_totalprice"))


@register("class_balance")
def q_class_balance(spark, sf):
    return profile.class_balance(dirty_lineitem(spark, sf), "target")


@register("task_type_detect")
def q_task_type_detect(spark, sf):
    return profile.detect_task_types(load(spark, sf, "lineitem"))


@register("structure_report")
def q_structure_report(spark, sf):
    return round_floats(profile.structure_report(load(spark, sf, "lineitem")))


@register("payload_bytes")
def q_payload_bytes(spark, sf):
    return profile.payload_bytes(load(spark, sf, "lineitem"))


# ── cleaning ─────────────────────────────────────────────────────────────────

DIRTY_CLIP_COLUMNS = ["l_orderkey", "l_linenumber", "price"]


def _clean_base(spark, sf):
    """dirty → drop sparse columns → dedup → drop missing target; written once for the steps after it."""
    d = clean.drop_sparse_columns(dirty_lineitem(spark, sf), "target")
    return cut_lineage(clean.drop_null_target(clean.dedup_rows(d), "target"))


def nan_prices(spark, sf):
    """The dirty lines with NaN instead of NULL prices."""
    return dirty_lineitem(spark, sf).select("l_orderkey", "l_linenumber",
                                            F.coalesce("price", F.lit(float("nan"))).alias("price"))


def _imputed(spark, sf):
    t, _ = clean.impute_median(_clean_base(spark, sf))
    t, _ = clean.impute_mode(t)
    return t


@register("drop_sparse_columns")
def q_drop_sparse_columns(spark, sf):
    return clean.drop_sparse_columns(dirty_lineitem(spark, sf), "target")


@register("dedup_rows")
def q_dedup_rows(spark, sf):
    return clean.dedup_rows(dirty_lineitem(spark, sf))


@register("duplicates_removed")
def q_duplicates_removed(spark, sf):
    return clean.duplicates_removed(dirty_lineitem(spark, sf))


@register("drop_null_target")
def q_drop_null_target(spark, sf):
    return clean.drop_null_target(dirty_lineitem(spark, sf), "target")


@register("impute_median")
def q_impute_median(spark, sf):
    t, _ = clean.impute_median(_clean_base(spark, sf))
    return round_floats(t)


@register("impute_mode")
def q_impute_mode(spark, sf):
    return round_floats(_imputed(spark, sf))


@register("quartiles")
def q_quartiles(spark, sf):
    return round_floats(clean.quartiles(_imputed(spark, sf), DIRTY_CLIP_COLUMNS))


@register("outlier_count")
def q_outlier_count(spark, sf):
    return clean.outlier_count(_imputed(spark, sf), DIRTY_CLIP_COLUMNS)


@register("outliers_with_nan")
def q_outliers_with_nan(spark, sf):
    """Outliers of dirty columns whose gaps are NaN: a gap is neither counted nor clipped."""
    d = nan_prices(spark, sf)
    return clean.outlier_count(d, DIRTY_CLIP_COLUMNS)


@register("clip_with_nan")
def q_clip_with_nan(spark, sf):
    out, _ = clean.iqr_clip(nan_prices(spark, sf), DIRTY_CLIP_COLUMNS)
    return round_floats(out.select("l_orderkey", "l_linenumber",
                                   F.nanvl("price", F.lit(None).cast("double")).alias("price")))


@register("iqr_clip")
def q_iqr_clip(spark, sf):
    return round_floats(clean.clean_table(dirty_lineitem(spark, sf), "target").table)


@register("clip_bounds")
def q_clip_bounds(spark, sf):
    return clean.clean_table(dirty_lineitem(spark, sf), "target").clip_bounds


@register("cleaning_report")
def q_cleaning_report(spark, sf):
    return _cleaning_report(dirty_lineitem(spark, sf))


def _cleaning_report(dirty, counts=None):
    r = clean.clean_table(dirty, "target", counts=counts)
    r.release()         # the report is known by now, the cleaned rows are not read again
    return clean.cleaning_report_frame(dirty.sparkSession, r.report)


# ── features ─────────────────────────────────────────────────────────────────

ID = ("o_orderkey",)


def _features(spark, sf, target="o_orderstatus"):
    of = order_features(spark, sf)
    return of, encode.fit_features(of, target, id_cols=ID)


def _mi(spark, sf, target, discrete, estimator="bins"):
    of = cut_lineage(order_features(spark, sf))
    fm = encode.fit_features(of, target, id_cols=ID)
    enc = fm.encode(of)
    feats = fm.feature_columns
    means = {c: fm.scaler[c][0] for c in feats if c in fm.scaler}
    return select.feature_scores(enc, feats, target, discrete, estimator, fill=means)


@register("ordinal_encode")
def q_ordinal_encode(spark, sf):
    of = order_features(spark, sf)
    return encode.ordinal_encode(of, ["o_orderpriority", "c_mktsegment"]).select(
        "o_orderkey", "o_orderpriority", "c_mktsegment")


@register("rare_to_other")
def q_rare_to_other(spark, sf):
    return encode.rare_to_other(load(spark, sf, "part").select("p_partkey", "p_name"), ["p_name"])


@register("one_hot_encode")
def q_one_hot_encode(spark, sf):
    return encode.one_hot_encode(order_features(spark, sf).select("o_orderkey", "n_name"),
                                 ["n_name"])


@register("standard_scale")
def q_standard_scale(spark, sf):
    of, fm = _features(spark, sf)
    return round_floats(fm.transform(of))


@register("low_variance_columns")
def q_low_variance_columns(spark, sf):
    of, fm = _features(spark, sf)
    scaled = fm.transform(of).withColumn("unit_flag", F.lit(7.0))
    return encode.low_variance_columns(scaled, [*fm.feature_columns, "unit_flag"])


@register("features_as_double")
def q_features_as_double(spark, sf):
    return encode.features_as_double(order_features(spark, sf), [
        "o_orderkey", "o_totalprice", "c_acctbal", "n_lines", "avg_discount", "sum_qty"])


@register("label_encode")
def q_label_encode(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return encode.label_encode(o, "o_orderstatus", out="label").select("o_orderkey", "label")


@register("mi_classification")
def q_mi_classification(spark, sf):
    return _mi(spark, sf, "o_orderstatus", True)


@register("mi_neighbours_class")
def q_mi_neighbours_class(spark, sf):
    return _mi(spark, sf, "o_orderstatus", True, "neighbours")


@register("mi_neighbours_number")
def q_mi_neighbours_number(spark, sf):
    return _mi(spark, sf, "o_totalprice", False, "neighbours")


@register("mi_regression")
def q_mi_regression(spark, sf):
    return _mi(spark, sf, "o_totalprice", False)


@register("select_top_features")
def q_select_top_features(spark, sf):
    return select.select_top_features(_mi(spark, sf, "o_orderstatus", True), 10)


FEATURE_COUNTS = ["features_before", "features_after", "n_low_variance", "n_scaled", "n_ordinal", "n_one_hot"]


@register("feature_report")
def q_feature_report(spark, sf):
    """Counts, lists (sorted), settings, and the selected features with their scores, best first."""
    of = order_features(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fm = encode.fit_features(of, "o_orderstatus", id_cols=ID)
        feats = fm.feature_columns
        scores = select.mutual_information(fm.encode(of), feats, "o_orderstatus", True,
                                           fill={c: fm.scaler[c][0] for c in feats if c in fm.scaler})
        best = select.select_top_features(scores).orderBy("rk").collect()       # at most top_k rows
        task = profile.detect_task_type(of, "o_orderstatus")
    finally:
        of.unpersist()
    return spark.createDataFrame([(
        len(fm.features_before), len(feats), len(fm.low_variance), len(fm.scaler), len(fm.ordinal), len(fm.one_hot),
        sorted(fm.low_variance), sorted(fm.scaler), sorted(fm.ordinal), sorted(fm.one_hot),
        [r["feature"] for r in best], [r["mi"] for r in best], select.DEFAULT_TOP_K,
        encode.ORDINAL_CARDINALITY_THRESHOLD, task)],
        ", ".join(f"{c} INT" for c in FEATURE_COUNTS) + ", dropped_low_variance ARRAY<STRING>, numeric_scaled ARRAY<STRING>, "
        "ordinal_encoded ARRAY<STRING>, one_hot_encoded ARRAY<STRING>, features_selected ARRAY<STRING>, "
        "mi_scores ARRAY<DOUBLE>, top_k INT, ordinal_cardinality_threshold INT, task_type STRING")


# ── split, metrics, ranking ──────────────────────────────────────────────────

@register("train_test_split")
def q_train_test_split(spark, sf):
    return split.assign_split(load(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@register("split_partition_check")
def q_split_partition_check(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey")
    train, test = split.train_test_split(o, "o_orderkey")
    return split.split_partition_check(o, train, test, "o_orderkey")


@register("split_sizes")
def q_split_sizes(spark, sf):
    lab = split.assign_split(load(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return lab.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@register("metric_accuracy")
def q_metric_accuracy(spark, sf):
    return metrics.accuracy(binary_predictions(spark, sf))


@register("metric_prf_weighted")
def q_metric_prf_weighted(spark, sf):
    return metrics.prf_weighted(multiclass_predictions(spark, sf))


@register("metric_auc_binary")
def q_metric_auc_binary(spark, sf):
    return metrics.auc_binary(binary_predictions(spark, sf))


@register("metric_auc_ovr")
def q_metric_auc_ovr(spark, sf):
    return metrics.auc_ovr(multiclass_predictions(spark, sf), "y",
                           {"F": "p_F", "O": "p_O", "P": "p_P"})


@register("metric_regression")
def q_metric_regression(spark, sf):
    return metrics.regression_metrics(regression_predictions(spark, sf))


def _binary_metrics_with_bookkeeping(spark, sf):
    """Metrics of the rule models, a few rows per model, computed once and read by every step after it."""
    found = _binary_metrics(spark, sf)
    return spark.createDataFrame([tuple(r) for r in found.collect()], found.schema)


def _binary_metrics(spark, sf):
    preds = binary_predictions(spark, sf)
    m = metrics.classification_metrics(preds, score="score")
    lab = split.assign_split(load(spark, sf, "labels").select("doc_id"), "doc_id")
    book = (preds.join(lab, "doc_id").groupBy("model")
            .agg(F.count_if(F.col("part") == "train").cast("double").alias("n_train"),
                 F.count_if(F.col("part") == "test").cast("double").alias("n_test"))
            .select("model", F.inline(F.array(
                F.struct(F.lit("n_train").alias("metric"), F.col("n_train").alias("value")),
                F.struct(F.lit("n_test").alias("metric"), F.col("n_test").alias("value"))))))
    return m.unionByName(book)


@register("metrics_long")
def q_metrics_long(spark, sf):
    return metrics.pure_metrics(_binary_metrics_with_bookkeeping(spark, sf))


@register("rank_models")
def q_rank_models(spark, sf):
    return rank.rank_models(_binary_metrics_with_bookkeeping(spark, sf), "classification")


@register("model_comparison")
def q_model_comparison(spark, sf):
    return rank.model_comparison(_binary_metrics_with_bookkeeping(spark, sf), "classification")


@register("metrics_pivot")
def q_metrics_pivot(spark, sf):
    return rank.metrics_pivot(_binary_metrics_with_bookkeeping(spark, sf), "classification")


@register("evaluation_summary")
def q_evaluation_summary(spark, sf):
    return rank.evaluation_summary(_binary_metrics_with_bookkeeping(spark, sf), "classification")


# ── chart data ───────────────────────────────────────────────────────────────

# Every numeric column of lineitem.
LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax"]


@register("histogram_density")
def q_histogram_density(spark, sf):
    return round_floats(chartdata.histogram(load(spark, sf, "lineitem"), LINE_NUMBERS), 6)


@register("histogram_ten_bins")
def q_histogram_ten_bins(spark, sf):
    return round_floats(chartdata.histogram(load(spark, sf, "lineitem"), LINE_NUMBERS, bins=10), 6)


@register("kde_curve")
def q_kde_curve(spark, sf):
    out = chartdata.kde_curve(load(spark, sf, "lineitem"), LINE_NUMBERS)
    return out.select("column", "gi", F.round("x", 6).alias("x"),
                      F.round(F.col("density") * 1e6, 4).alias("density_e6"))


@register("box_stats")
def q_box_stats(spark, sf):
    return round_floats(chartdata.box_stats(load(spark, sf, "lineitem"), LINE_NUMBERS))


@register("category_bars")
def q_category_bars(spark, sf):
    return chartdata.category_bars(load(spark, sf, "part"), ["p_name", "p_brand", "p_type"])


@register("corr_lower_triangle")
def q_corr_lower_triangle(spark, sf):
    return chartdata.corr_lower_triangle(load(spark, sf, "lineitem"), LINE_NUMBERS)


@register("target_distribution_classes")
def q_target_distribution_classes(spark, sf):
    return chartdata.target_distribution(load(spark, sf, "orders"), "o_orderpriority", numeric=False)


@register("target_distribution")
def q_target_distribution(spark, sf):
    return round_floats(chartdata.target_distribution(load(spark, sf, "orders"), "o_totalprice",
                                                      numeric=True))


# ── run log and catalog ──────────────────────────────────────────────────────

def _latest(spark, sf):
    return runlog.run_latest_state(run_events(spark, sf))


def _catalog(spark, sf):
    return runlog.dataset_catalog(datasets(spark, sf), run_events(spark, sf))


@register("run_transitions_valid")
def q_run_transitions_valid(spark, sf):
    return runlog.run_transitions_valid(run_events(spark, sf))


@register("run_latest_state")
def q_run_latest_state(spark, sf):
    return _latest(spark, sf)


@register("run_store_latest")
def q_run_store_latest(spark, sf):
    run = uuid.uuid4().hex
    store = RunStore(spark, f"runs_{run}", f"{ensure_checkpoint_dir(spark)}/runs_{run}")
    events = run_events(spark, sf)
    late = F.col("ts") >= F.lit("2024-01-16")
    for part in (events.where(late), events.where(F.coalesce(~late, F.lit(True)))):
        store.append(part)
    return store.latest()


@register("runs_by_status")
def q_runs_by_status(spark, sf):
    return runlog.runs_by_status(_latest(spark, sf))


@register("run_counts")
def q_run_counts(spark, sf):
    return runlog.run_counts(_latest(spark, sf))


@register("page_newest")
def q_page_newest(spark, sf):
    return runlog.page_newest(_catalog(spark, sf), skip=5, limit=10)


@register("page_deep")
def q_page_deep(spark, sf):
    items = load(spark, sf, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    order = [("l_shipdate", True), ("l_orderkey", False), ("l_linenumber", False)]
    return pages.page(items, order, items.count() // 2, 50, deep=1000)


@register("runs_by_dataset")
def q_runs_by_dataset(spark, sf):
    return runlog.runs_by_dataset(_latest(spark, sf), 7, skip=0, limit=20)


@register("first_by_name")
def q_first_by_name(spark, sf):
    return runlog.first_by_name(_catalog(spark, sf), "NATION_3")


@register("run_with_dataset")
def q_run_with_dataset(spark, sf):
    return runlog.run_with_dataset(_latest(spark, sf), _catalog(spark, sf))


@register("runs_after_delete")
def q_runs_after_delete(spark, sf):
    deleted = datasets(spark, sf).where(F.col("n_regionkey") == 0)
    return runlog.runs_after_delete(_latest(spark, sf), deleted)


@register("dataset_latest")
def q_dataset_latest(spark, sf):
    return runlog.dataset_latest(dataset_patches(spark, sf))


@register("stage_timeline")
def q_stage_timeline(spark, sf):
    return runlog.stage_timeline(run_events(spark, sf))


@register("run_errors")
def q_run_errors(spark, sf):
    return runlog.run_errors(run_events(spark, sf))


@register("run_outcome")
def q_run_outcome(spark, sf):
    return runlog.run_outcome(run_events(spark, sf))


@register("dataset_registry")
def q_dataset_registry(spark, sf):
    out = None
    for t in ("orders", "customer", "part", "lineitem"):
        row = runlog.registration_row(load(spark, sf, t), t)
        out = row if out is None else out.unionByName(row)
    return out


# ── previews, scalar functions, inference, plan and report ───────────────────

@register("preview_orders")
def q_preview_orders(spark, sf):
    return profile.preview(load(spark, sf, "orders"), ["o_orderkey"], 5)


@register("safe_sample")
def q_safe_sample(spark, sf):
    return profile.preview(load(spark, sf, "customer"), ["c_custkey"], 5)


@register("safe_identifier")
def q_safe_identifier(spark, sf):
    from tabloom.functions.columns import safe_identifier
    return load(spark, sf, "pages").select("page_id", safe_identifier(F.col("url")).alias("safe_url"))


@register("column_types")
def q_column_types(spark, sf):
    """Types inferred from the text of a CSV export of ``orders``."""
    from tabloom.functions.columns import type_label
    text = csv_ingest.stringify(load(spark, sf, "orders"))
    types = csv_ingest.infer_types(text)
    typed = csv_ingest.apply_types(text, types)
    rows = [(c, types[c], type_label(typed.schema[c].dataType)) for c in text.columns]
    return spark.createDataFrame(rows, "column STRING, inferred_type STRING, label STRING")


@register("plan_profile")
def q_plan_profile(spark, sf):
    return profile.plan_profile(dirty_lineitem(spark, sf), "target")


@register("report_sections")
def q_report_sections(spark, sf):
    """The ten sections over the dirty lines, the modelling table, the rule models and the run log.
    The missing counts of the dirty lines are taken once for the plan, the quality section and the cleaning."""
    d = dirty_lineitem(spark, sf)
    missing = profile.missing_counts(d)
    missing = spark.createDataFrame([tuple(r) for r in missing.collect()], missing.schema)      # one row per column
    scores = _binary_metrics_with_bookkeeping(spark, sf)
    ranked = rank.rank_models(scores, "classification")
    plan = profile.plan_profile(d, "target", counts=missing)
    stages = runlog.stage_timeline(run_events(spark, sf)).groupBy("stage", "status").agg(F.count("*").alias("n"))
    value = F.format_string("%.4f", "value")
    return report.report_sections([
        report.fields(report.SUMMARY, profile.table_shape(d), ["n_rows", "n_cols"]),
        report.fields(report.OVERVIEW, plan, ["n_rows", "n_cols", "task_type", "n_features", "n_numeric", "n_categorical",
                                              "has_missing", "n_high_missing"]),
        report.section(report.QUALITY, profile.missing_report(d, missing), F.col("column"), F.format_string("%.2f", "pct")),
        report.fields(report.CLEANING, _cleaning_report(d, missing), [
            "rows_before", "rows_after", "rows_dropped", "duplicates_removed", "target_missing_dropped"]),
        report.fields(report.FEATURES, q_feature_report(spark, sf), FEATURE_COUNTS),
        report.section(report.TRAINING, metrics.pure_metrics(scores), F.concat_ws(":", "model", "metric"), value),
        report.section(report.LEADERBOARD, ranked, F.concat_ws(":", F.col("rk").cast("string"), "model"),
                       F.format_string("%.4f", "primary_score")),
        report.section(report.BEST, ranked.where("rk = 1"), F.lit("best_model"), F.col("model")),
        report.section(report.TIMELINE, stages, F.concat_ws(":", "stage", "status"), F.col("n")),
        report.section(report.APPENDIX, profile.column_types(d), F.col("column"), F.col("label"))])


# ── models (rows-only checks, except the OLS fit) ────────────────────────────

def _model_data(spark, sf, task):
    """Feature table ready for Spark ML: classification on document quality,
    regression on order totals. Returns (train, test, features, n_classes)."""
    if task == "classification":
        df, target, key = document_features(spark, sf), "quality", "doc_id"
    else:
        df, target, key = order_features(spark, sf).drop("o_orderstatus"), "o_totalprice", \
            "o_orderkey"
    fm = encode.fit_features(df, target, id_cols=(key,))
    feats = fm.feature_columns
    t = fm.transform(df).na.fill(0.0, subset=feats)
    t = t.select(key, *[F.col(c).cast("double") for c in feats],
                 F.col(target).cast("double").alias("_label"))
    train, test = split.train_test_split(t, key)
    return train, test, feats, (2 if task == "classification" else 0)


def _train(spark, sf, name, task):
    train, test, feats, k = _model_data(spark, sf, task)
    return models.train_model(name, train, test, feats, "_label", task, k).metrics.where(
        ~F.col("metric").isin("train_duration_seconds"))


@register("train_rf_classifier")
def q_train_rf_classifier(spark, sf):
    return _train(spark, sf, "random_forest", "classification")


@register("train_rf_regressor")
def q_train_rf_regressor(spark, sf):
    return _train(spark, sf, "random_forest", "regression")


@register("train_logreg")
def q_train_logreg(spark, sf):
    return _train(spark, sf, "logistic_regression", "classification")


@register("train_gbt_classifier")
def q_train_gbt_classifier(spark, sf):
    return _train(spark, sf, "xgboost", "classification")


@register("train_gbt_regressor")
def q_train_gbt_regressor(spark, sf):
    return _train(spark, sf, "xgboost", "regression")


@register("train_one")
def q_train_one(spark, sf):
    return _train(spark, sf, "linear_regression", "regression")


@register("train_all")
def q_train_all(spark, sf):
    train, test, feats, k = _model_data(spark, sf, "classification")
    done, _ = models.train_all(["random_forest", "logistic_regression", "xgboost"], train, test,
                               feats, "_label", "classification", k)
    return rank.model_comparison(models.metrics_table(done), "classification").drop(
        "train_duration_seconds")


@register("score_holdout")
def q_score_holdout(spark, sf):
    train, test, feats, k = _model_data(spark, sf, "classification")
    m = models.train_model("logistic_regression", train, test, feats, "_label", "classification", k)
    from pyspark.ml.functions import vector_to_array
    return m.model.transform(test).select(
        "doc_id", "_label", "prediction", vector_to_array("probability")[1].alias("p_positive"))


@register("train_linreg")
def q_train_linreg(spark, sf):
    """OLS of an order's total on its line quantity (one feature)."""
    of = order_features(spark, sf).where(F.col("sum_qty").isNotNull())
    return round_floats(models.linear_fit(of, "sum_qty", "o_totalprice"))


@register("train_linreg_two")
def q_train_linreg_two(spark, sf):
    """OLS of every order's total (in thousands) on its number of lines and its customer's balance."""
    of = order_features(spark, sf).select(F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "c_acctbal",
                                          (F.col("o_totalprice") / 1000.0).alias("total"))
    m = models.train_ols(of, ["n_lines", "c_acctbal"], "total")
    row = (round(float(m.intercept), 4), round(float(m.coefficients[0]), 4), round(float(m.coefficients[1]), 6))
    return spark.createDataFrame([row], "intercept DOUBLE, w_lines DOUBLE, w_balance DOUBLE")
