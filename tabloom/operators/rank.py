"""Model ranking, comparison table, evaluation summary and metric pivot.

The inputs hold one row per (model, metric): their size is set by the
number of models, so ordering them globally is cheap and exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.metrics import (BOOKKEEPING, CLASSIFICATION_METRICS, REGRESSION_METRICS,
                                       pure_metrics)


def primary_metric(task_type: str) -> tuple[str, bool]:
    """(metric, higher_is_better)."""
    return ("f1_weighted", True) if task_type == "classification" else ("rmse", False)


def rank_models(metrics_long: DataFrame, task_type: str) -> DataFrame:
    """``(rk, model, primary_score)``; a model without the primary metric
    ranks last; equal scores are ordered by model name."""
    metric, higher = primary_metric(task_type)
    models = metrics_long.select("model").distinct()
    scores = (pure_metrics(metrics_long).where(F.col("metric") == metric)
              .groupBy("model").agg(F.first("value").alias("primary_score")))
    order = F.desc_nulls_last("primary_score") if higher else F.asc_nulls_last("primary_score")
    return (models.join(scores, "model", "left")
            .withColumn("rk", F.row_number().over(Window.orderBy(order, F.asc("model"))))
            .select("rk", "model", "primary_score"))


def metrics_pivot(metrics_long: DataFrame, task_type: str) -> DataFrame:
    """Models × metrics in the fixed metric order; missing cells stay NULL."""
    names = (CLASSIFICATION_METRICS if task_type == "classification" else REGRESSION_METRICS)
    return (metrics_long.groupBy("model").pivot("metric", names + BOOKKEEPING)
            .agg(F.first("value")))


def model_comparison(metrics_long: DataFrame, task_type: str) -> DataFrame:
    """Ranked models joined with their metrics and bookkeeping by model name."""
    return (rank_models(metrics_long, task_type)
            .join(metrics_pivot(metrics_long, task_type), "model", "left"))


def best_artifact(leaderboard: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The best model with its artifact: ``(model, primary_score, path)``; path NULL if none was saved."""
    return (leaderboard.where(F.col("rk") == 1).join(artifacts, "model", "left")
            .select("model", "primary_score", "path"))


def evaluation_summary(metrics_long: DataFrame, task_type: str) -> DataFrame:
    """One row: primary metric, direction, best model and score, model count."""
    metric, higher = primary_metric(task_type)
    ranked = rank_models(metrics_long, task_type)
    return ranked.agg(
        F.lit(metric).alias("primary_metric"),
        F.lit("higher_is_better" if higher else "lower_is_better").alias("direction"),
        F.min_by("model", "rk").alias("best_model"),
        F.min_by("primary_score", "rk").alias("best_score"),
        F.count(F.lit(1)).alias("n_models"))
