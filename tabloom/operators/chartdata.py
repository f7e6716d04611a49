"""Chart data: the tables behind the reference's EDA figures.

Drawing is out of scope; what scales is computing the numbers. Every
table here is a small aggregate (bins × columns, grid × columns, one row
per column) produced by partial aggregation, never by moving rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import long_form
from tabloom.functions.heavy_hitters import top_counts
from tabloom.functions.quantiles import column_quantiles
from tabloom.operators.profile import correlation_matrix

# Fixed values of the reference behaviour.
HIST_BINS = 30
BAR_TOP = 20
BOX_WHISKER = 1.5
KDE_POINTS = 100
# Of the series: terms, and how many bandwidths from a box's centre a kernel is more than nothing.
KDE_TERMS = 14
KDE_REACH = 39.0


def _ranges(long: DataFrame, bins: int) -> DataFrame:
    """Per column: lo, hi, width for ``bins`` equal bins (a degenerate range
    is widened by 0.5 on each side, as numpy does)."""
    r = long.groupBy("column").agg(F.min("value").alias("lo0"), F.max("value").alias("hi0"),
                                   F.count("value").alias("n_all"))
    same = F.col("lo0") == F.col("hi0")
    return r.select("column", "n_all",
                    F.when(same, F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
                    F.when(same, F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi")
                    ).withColumn("w", (F.col("hi") - F.col("lo")) / bins)


def histogram(df: DataFrame, columns: list[str], bins: int = HIST_BINS,
              density: bool = True) -> DataFrame:
    """``(column, bin, lo, hi, n[, density])`` for every bin, empty ones included.

    The last bin is closed on the right (the maximum falls in it). Infinite
    values count as missing.
    """
    long = long_form(df, columns, "double", finite=True).where(F.col("value").isNotNull())
    rng = _ranges(long, bins)
    binned = (long.join(F.broadcast(rng), "column")          # one row per column
              .withColumn("bin", F.least(F.floor((F.col("value") - F.col("lo")) / F.col("w")),
                                         F.lit(bins - 1)).cast("int"))
              .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n")))
    grid = rng.select("column", "lo", "w", "n_all",
                      F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = (grid.join(binned, ["column", "bin"], "left")
           .select("column", "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("lo"),
                   (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("hi"),
                   F.coalesce("n", F.lit(0)).alias("n"), "n_all", "w"))
    if density:
        out = out.withColumn("density", F.col("n") / (F.col("n_all") * F.col("w")))
    return out.drop("n_all", "w")


def kde_curve(df: DataFrame, columns: list[str], points: int = KDE_POINTS) -> DataFrame:
    """``(column, gi, x, density)``: Gaussian KDE with Scott's bandwidth
    (sample std · n^(-1/5)) on ``points`` grid points spanning
    [min - range/2, max + range/2]. Columns with fewer than 2 values or no
    spread are skipped; infinite values count as missing.

    A fast Gauss transform: values are added up in boxes half a bandwidth wide
    as the moments of their distance from the box's centre, in one aggregate;
    a box then gives its part of a grid point by the Hermite series
    exp(-(t - s)^2 / 2) = exp(-t^2 / 2) sum He_n(t) s^n / n!. With |s| <= 1/4
    and ``KDE_TERMS`` terms a value's kernel is off by less than
    1.1 (1/4)^14 / sqrt(14!) < 2e-14. Points out of a box's reach get 0.
    """
    long = long_form(df, columns, "double", finite=True).where(F.col("value").isNotNull())
    st = {r["column"]: r for r in (
        long.groupBy("column").agg(F.count("value").alias("n"), F.stddev_samp("value").alias("sd"),
                                   F.min("value").alias("mn"), F.max("value").alias("mx"))
        .where((F.col("n") >= 2) & (F.col("sd") > 0)).collect())}       # one row per column
    schema = "column STRING, gi INT, x DOUBLE, density DOUBLE"
    used = [c for c in columns if c in st]
    if not used:
        return df.sparkSession.createDataFrame([], schema)
    norm = 1.0 / math.sqrt(2 * math.pi)
    rows = []
    for c in used:
        r, bw = st[c], st[c]["sd"] * st[c]["n"] ** -0.2
        rows.append((c, float(r["mn"]), bw, r["mn"] - (r["mx"] - r["mn"]) / 2, 2 * (r["mx"] - r["mn"]) / (points - 1),
                     norm / (r["n"] * bw)))
    about = df.sparkSession.createDataFrame(rows, "column STRING, mn DOUBLE, bw DOUBLE, g0 DOUBLE, step DOUBLE, scale DOUBLE")
    about = F.broadcast(about)                                          # one row per column
    placed = long_form(df, used, "double", finite=True).where("value IS NOT NULL").join(about, "column").selectExpr(
        "column", "floor((value - mn) / bw * 2) AS box", "value", "mn", "bw").selectExpr(
        "column", "box", "(value - mn) / bw - (box + 0.5D) / 2 AS s")
    moments = placed.groupBy("column", "box").agg(
        F.count("*").alias("a0"), *[F.expr(f"sum({'*'.join(['s'] * n)})").alias(f"a{n}") for n in range(1, KDE_TERMS)])
    # The series as a polynomial in t, one set of coefficients per box.
    terms = _hermite(KDE_TERMS)
    parts = [" + ".join(f"a{n} * ({terms[n][j] / math.factorial(n)!r}D)" for n in range(j, KDE_TERMS) if terms[n][j])
             for j in range(KDE_TERMS)]
    boxes = moments.join(about, "column").selectExpr(
        "column", "g0", "step", "bw", "mn + (box + 0.5D) * bw / 2 AS centre", *[f"{e} AS q{j}" for j, e in enumerate(parts)])
    reach = boxes.withColumns({
        "first": F.expr(f"greatest(0, ceil((centre - {KDE_REACH}D * bw - g0) / step))"),
        "last": F.expr(f"least({points - 1}, floor((centre + {KDE_REACH}D * bw - g0) / step))")}).where("first <= last")
    at = reach.withColumn("gi", F.explode(F.sequence("first", "last"))).withColumn("t", F.expr("(g0 + gi * step - centre) / bw"))
    horner = f"q{KDE_TERMS - 1}"
    for j in reversed(range(KDE_TERMS - 1)):
        horner = f"({horner}) * t + q{j}"
    sums = at.groupBy("column", F.col("gi").cast("int").alias("gi")).agg(F.expr(f"sum(exp(-t * t / 2) * ({horner}))").alias("sum"))
    grid = about.select("column", "g0", "step", "scale", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("gi"))
    return grid.join(sums, ["column", "gi"], "left").select(
        "column", "gi", (F.col("g0") + F.col("gi") * F.col("step")).alias("x"),
        F.greatest(F.coalesce("sum", F.lit(0.0)) * F.col("scale"), F.lit(0.0)).alias("density"))


def _hermite(n: int) -> list[list[int]]:
    """Coefficients of the Hermite polynomials He_0 .. He_(n - 1), by rising power."""
    out = [[1] + [0] * (n - 1), [0, 1] + [0] * (n - 2)]
    for k in range(1, n - 1):
        out.append([(out[k][j - 1] if j else 0) - k * out[k - 1][j] for j in range(n)])
    return out[:n]


def box_stats(df: DataFrame, columns: list[str], whisker: float = BOX_WHISKER) -> DataFrame:
    """``(column, q1, median, q3, whisker_lo, whisker_hi, n_fliers)``: whiskers end
    at the most extreme values inside [q1 - 1.5·iqr, q3 + 1.5·iqr]."""
    spark = df.sparkSession
    long = long_form(df, columns, "double").where(F.col("value").isNotNull())
    q = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    rows = []
    for c in columns:
        if q.get((c, 0.25)) is None:
            continue
        q1, med, q3 = q[(c, 0.25)], q[(c, 0.5)], q[(c, 0.75)]
        iqr = q3 - q1
        rows.append((c, q1, med, q3, q1 - whisker * iqr, q3 + whisker * iqr))
    b = spark.createDataFrame(rows, "column STRING, q1 DOUBLE, median DOUBLE, q3 DOUBLE, "
                                    "lo DOUBLE, hi DOUBLE")
    inside = (F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))
    agg = (long.join(F.broadcast(b), "column")
           .groupBy("column").agg(F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
                                  F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
                                  F.count_if(~inside).alias("n_fliers")))
    return b.join(agg, "column").select("column", "q1", "median", "q3", "whisker_lo",
                                        "whisker_hi", "n_fliers")


def category_bars(df: DataFrame, columns: list[str], k: int = BAR_TOP) -> DataFrame:
    """``(column, value, n, rk)``: the k most frequent values per column."""
    return top_counts(df, columns, k)


def corr_lower_triangle(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlations with 2 decimals for pairs (a, b) where a comes at or after b."""
    pos = {c: i for i, c in enumerate(columns)}
    m = correlation_matrix(df, columns, digits=2)
    idx = F.create_map(*[x for c, i in pos.items() for x in (F.lit(c), F.lit(i))])
    return m.where(idx[F.col("col_a")] >= idx[F.col("col_b")])


def target_distribution(df: DataFrame, target: str, numeric: bool,
                        bins: int = HIST_BINS, k: int = BAR_TOP) -> DataFrame:
    """30-bin counts of a numeric target, or its 20 most frequent classes."""
    if numeric:
        return histogram(df, [target], bins, density=False)
    return category_bars(df, [target], k)
