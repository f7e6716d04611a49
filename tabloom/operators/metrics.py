"""Model metrics over prediction tables, grouped by model.

Inputs are long prediction tables ``(model, y, pred[, score])``; every
metric is one distributed aggregate per model, and the outputs are long
``(model, metric, value)`` rows rounded to 4 decimals like the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.ranking import running_sums
from tabloom.session import cut_lineage

DIGITS = 4
CLASSIFICATION_METRICS = ["accuracy", "f1_weighted", "precision_weighted", "recall_weighted",
                          "roc_auc"]
REGRESSION_METRICS = ["mae", "mse", "rmse", "r2"]
BOOKKEEPING = ["train_duration_seconds", "n_train", "n_test"]


def _long(df: DataFrame, by: str, names: list[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                    for n in names])
    return df.select(by, F.inline(arr))


def accuracy(df: DataFrame, y: str = "y", pred: str = "pred", by: str = "model") -> DataFrame:
    """``(model, accuracy)``."""
    hit = (F.col(y).cast("string") == F.col(pred).cast("string")).cast("double")
    return df.groupBy(by).agg(F.round(F.avg(hit), DIGITS).alias("accuracy"))


def prf_weighted(df: DataFrame, y: str = "y", pred: str = "pred", by: str = "model") -> DataFrame:
    """``(model, precision_weighted, recall_weighted, f1_weighted)``; support-weighted,
    a zero denominator counts as 0."""
    conf = df.groupBy(by, F.col(y).cast("string").alias("t"),
                      F.col(pred).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # Each confusion cell adds to the support of its true class and to the
    # predicted count of its predicted class.
    contrib = conf.select(by, F.inline(F.array(
        F.struct(F.col("t").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long")
                 .alias("predicted"), F.when(F.col("t") == F.col("p"), F.col("n"))
                 .otherwise(F.lit(0)).alias("tp")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))))
    per = contrib.groupBy(by, "cls").agg(F.sum("support").alias("s"), F.sum("predicted").alias("pc"),
                                         F.sum("tp").alias("tp"))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("pc")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("s")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return per.groupBy(by).agg(
        F.round(F.sum(prec * F.col("s")) / F.sum("s"), DIGITS).alias("precision_weighted"),
        F.round(F.sum(rec * F.col("s")) / F.sum("s"), DIGITS).alias("recall_weighted"),
        F.round(F.sum(f1 * F.col("s")) / F.sum("s"), DIGITS).alias("f1_weighted"))


def _auc(hist: DataFrame, keys: list[str]) -> DataFrame:
    """AUC per ``keys`` from ``(keys..., score, pos, neg)`` rows (one per distinct score).

    Rank-sum with tied scores counted half: sum over scores of
    pos * (negatives below + neg / 2), divided by P * N. The negatives
    below each score come from distributed running sums.
    """
    cum = running_sums(hist, "score", ["neg"], partition_cols=keys)
    return cum.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("cum_neg") + F.col("neg") / 2.0)),
                     F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("n_pos"))


def auc_binary(df: DataFrame, y: str = "y", score: str = "score", by: str = "model",
               positive: str = "1") -> DataFrame:
    """``(model, roc_auc)`` of the positive-class score (NULL with one class only)."""
    is_pos = F.col(y).cast("string") == F.lit(positive)
    hist = cut_lineage(df.groupBy(by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(is_pos).alias("pos"), F.count_if(~is_pos).alias("neg")))
    return _auc(hist, [by]).select(by, F.round("auc", DIGITS).alias("roc_auc"))


def auc_ovr(df: DataFrame, y: str, class_scores: dict[str, str] | None = None, by: str = "model",
            score_array: str | None = None) -> DataFrame:
    """``(model, roc_auc)``: one-vs-rest AUC per class present in ``y``, macro average.

    ``class_scores`` maps class label -> score column; or ``score_array``
    names an array column whose element i is the score of class code i, for
    any number of classes.
    """
    if score_array:
        scores = F.posexplode(score_array).alias("cls", "score")
        long = df.select(by, F.col(y).cast("string").alias("_y"), scores).withColumn(
            "cls", F.col("cls").cast("double").cast("string"))
    else:
        long = df.select(by, F.col(y).cast("string").alias("_y"), F.inline(F.array(
            *[F.struct(F.lit(c).alias("cls"), F.col(s).cast("double").alias("score"))
              for c, s in class_scores.items()])))
    is_pos = F.col("_y") == F.col("cls")
    hist = cut_lineage(long.groupBy(by, "cls", "score").agg(F.count_if(is_pos).alias("pos"),
                                                            F.count_if(~is_pos).alias("neg")))
    # A class is present in y exactly if it has positives.
    per = _auc(hist, [by, "cls"]).where("auc IS NOT NULL AND n_pos > 0")
    return per.groupBy(by).agg(F.round(F.avg("auc"), DIGITS).alias("roc_auc"))


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "pred", by: str = "model"
                       ) -> DataFrame:
    """``(model, mae, mse, rmse, r2)``; R² = 1 - SSE / SST (SST = n · var_pop)."""
    e = F.col(y).cast("double") - F.col(pred).cast("double")
    g = df.groupBy(by).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
                           F.sum(e * e).alias("sse"),
                           (F.var_pop(F.col(y).cast("double")) * F.count(F.lit(1))).alias("sst"))
    r2 = F.when(F.col("sst") == 0, F.when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))) \
        .otherwise(1 - F.col("sse") / F.col("sst"))
    return g.select(by, F.round("mae", DIGITS).alias("mae"), F.round("mse", DIGITS).alias("mse"),
                    F.round(F.sqrt("mse"), DIGITS).alias("rmse"), F.round(r2, DIGITS).alias("r2"))


def classification_metrics(df: DataFrame, y: str = "y", pred: str = "pred",
                           score: str | None = None, class_scores: dict[str, str] | None = None,
                           by: str = "model", positive: str = "1",
                           score_array: str | None = None) -> DataFrame:
    """Long ``(model, metric, value)`` for accuracy, weighted P/R/F1 and AUC."""
    base = accuracy(df, y, pred, by).join(prf_weighted(df, y, pred, by), by)
    names = ["accuracy", "f1_weighted", "precision_weighted", "recall_weighted"]
    if class_scores or score_array:
        base = base.join(auc_ovr(df, y, class_scores, by, score_array), by, "left")
        names.append("roc_auc")
    elif score:
        base = base.join(auc_binary(df, y, score, by, positive), by, "left")
        names.append("roc_auc")
    return _long(base, by, names).where(F.col("value").isNotNull())


def regression_metrics_long(df: DataFrame, y: str = "y", pred: str = "pred", by: str = "model"
                            ) -> DataFrame:
    return _long(regression_metrics(df, y, pred, by), by, REGRESSION_METRICS)


def pure_metrics(metrics_long: DataFrame) -> DataFrame:
    """Drop bookkeeping rows (duration, split sizes) before ranking."""
    return metrics_long.where(~F.col("metric").isin(BOOKKEEPING))
