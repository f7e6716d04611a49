"""Mutual-information feature scores and top-k selection.

Two estimators. ``neighbours`` is the k-nearest-neighbour estimate
(operators/neighbours.py). ``bins`` is the plug-in estimate over equal-width
bins, an exact aggregate that a SQL engine can reproduce: every feature (missing values
read as 0) is cut into ``BINS`` equal-width bins over its own range; a
numeric target is binned the same way, a class target is used as is.
Features of few values are packed into one code (a pack of 0/1 dummies holds eight), and
one ``groupBy(code, y)`` over a row's packs gives every joint count; the counts per
feature and the marginals are sums of that small table. Scores serve to
rank features, which is what the selection uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import q, sql_finite, sql_lit
from tabloom.operators.neighbours import neighbour_information

BINS = 32
PACK_CODES = 256        # features of few values are counted together, up to so many combinations
DEFAULT_TOP_K = 20


def _packs(ranges: list[tuple[float | None, float | None, bool | None]]) -> list[tuple]:
    """``(pack, step, width, lo, hi, whole)`` per feature, given its ``(lo, hi, all values whole)``.

    A feature of whole values over fewer than ``BINS`` takes one code per value,
    any other one per bin. Features share a pack while the product of
    their widths is within ``PACK_CODES``; a pack's code is the sum of code times step.
    """
    slots = []
    for lo, hi, whole in ranges:
        lo, hi = (0.0, 0.0) if lo is None else (lo, hi)
        whole = whole is not False and hi - lo < BINS
        slots.append((int(hi - lo) + 1 if whole else BINS, lo, hi, whole))
    out: list = [None] * len(slots)
    pack, step = 0, 1
    for i in sorted(range(len(slots)), key=lambda i: slots[i][0]):
        if step * slots[i][0] > PACK_CODES:
            pack, step = pack + 1, 1
        out[i] = (pack, step, *slots[i])
        step *= slots[i][0]
    return out


def mutual_information(df: DataFrame, features: list[str], target: str,
                       discrete_target: bool, digits: int = 6,
                       fill: dict[str, float] | None = None) -> DataFrame:
    """``(feature, mi, rk)``: binned MI in nats, rank 1 = most informative.

    Missing and infinite feature values take ``fill[c]`` (default 0); rows
    without a finite target go. Equal-width bins
    do not change under a positive affine map, so scores of standardised
    features equal the scores of the unscaled ones when missing values are
    filled with the column mean (the point that standardises to 0); the
    pipeline scores the unscaled, exactly representable values.
    """
    spark = df.sparkSession
    fill = fill or {}
    y = f"CAST({q(target)} AS STRING)" if discrete_target else sql_finite(df, target)
    base = df.selectExpr(*[f"coalesce({sql_finite(df, c)}, {sql_lit(float(fill.get(c) or 0.0))})"
                           f" AS _x{i}" for i, c in enumerate(features)],
                         f"{y} AS _y").where("_y IS NOT NULL")
    # Ranges of every feature (and a numeric target), and whether all its values are whole, in one wide aggregate.
    aggs = [e for i in range(len(features)) for e in (f"min(_x{i}) AS lo{i}", f"max(_x{i}) AS hi{i}",
                                                      f"bool_and(_x{i} = rint(_x{i})) AS whole{i}")]
    if not discrete_target:
        aggs += ["min(_y) AS ylo", "max(_y) AS yhi"]
    r = base.selectExpr(*aggs).first()

    def binsql(v, lo, hi):
        if lo is None:
            return "0"
        if hi == lo:
            return "0"
        return (f"CAST(least(floor(({v} - {sql_lit(lo)}) / ({sql_lit(hi)} - {sql_lit(lo)}) * {BINS}),"
                f" {BINS - 1}) AS INT)")
    yb = "_y" if discrete_target else f"CAST({binsql('_y', r['ylo'], r['yhi'])} AS STRING)"
    layout = _packs([(r[f"lo{i}"], r[f"hi{i}"], r[f"whole{i}"]) for i in range(len(features))])
    codes: dict[int, list[str]] = {}
    for i, (pack, step, _, lo, hi, whole) in enumerate(layout):
        code = f"CAST(_x{i} - {sql_lit(lo)} AS INT)" if whole else binsql(f"_x{i}", lo, hi)
        codes.setdefault(pack, []).append(f"{code} * {step}")
    packed = ", ".join(f"{pack * PACK_CODES} + {' + '.join(c)}" for pack, c in codes.items())
    counts = (base.selectExpr(f"{yb} AS _y", f"explode(array({packed})) AS code").groupBy("code", "_y")
              .agg(F.count(F.lit(1)).alias("n_by")))
    # One row per feature: taken out of its pack again, over the small table of counts.
    places = spark.createDataFrame([(f"_b{i}", *x) for i, x in enumerate(layout)], (
        "_slot STRING, pack INT, step INT, width INT, lo DOUBLE, hi DOUBLE, whole BOOLEAN"))
    one = f"CAST(floor(code % {PACK_CODES} / step) AS INT) % width"
    joint = (counts.withColumn("pack", F.expr(f"CAST(floor(code / {PACK_CODES}) AS INT)")).join(F.broadcast(places), "pack")
             .selectExpr("_slot", "_y", "n_by", f"CASE WHEN NOT whole OR hi = lo THEN {one} ELSE CAST(least("
                         f"floor({one} / (hi - lo) * {BINS}), {BINS - 1}) AS INT) END AS b")
             .groupBy("_slot", "b", "_y").agg(F.sum("n_by").alias("n_by")))
    wf = Window.partitionBy("_slot")
    scored = (joint
              .withColumn("n", F.sum("n_by").over(wf))
              .withColumn("n_b", F.sum("n_by").over(Window.partitionBy("_slot", "b")))
              .withColumn("n_y", F.sum("n_by").over(Window.partitionBy("_slot", "_y")))
              .groupBy("_slot")
              .agg(F.sum(F.col("n_by") / F.col("n") *
                         F.ln(F.col("n_by") * F.col("n") / (F.col("n_b") * F.col("n_y"))))
                   .alias("mi")))
    names = spark.createDataFrame([(f"_b{i}", c) for i, c in enumerate(features)],
                                  "_slot STRING, feature STRING")
    out = (names.join(scored, "_slot", "left")
           .select("feature",
                   F.round(F.greatest(F.coalesce("mi", F.lit(0.0)), F.lit(0.0)), digits)
                   .alias("mi")))
    # One row per feature: a global order over this small table is cheap.
    return out.withColumn("rk", F.row_number().over(
        Window.orderBy(F.desc("mi"), F.asc("feature"))))


def feature_scores(df: DataFrame, features: list[str], target: str, discrete_target: bool, estimator: str = "neighbours",
                   fill: dict[str, float] | None = None) -> DataFrame:
    """``(feature, mi, rk)`` by the chosen estimator, ``neighbours`` or ``bins``."""
    if estimator == "bins":
        return mutual_information(df, features, target, discrete_target, fill=fill)
    if estimator != "neighbours":
        raise ValueError(f"unknown estimator '{estimator}'")
    found = neighbour_information(df, features, target, discrete_target, fill=fill)
    ranked = sorted(found.items(), key=lambda x: (-x[1], x[0]))     # one row per feature
    return df.sparkSession.createDataFrame([(c, v, k) for k, (c, v) in enumerate(ranked, 1)],
                                           "feature STRING, mi DOUBLE, rk INT")


def select_top_features(scores: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """The ``k`` best-scored features, ``(feature, mi, rk)``."""
    return scores.where(F.col("rk") <= k)
