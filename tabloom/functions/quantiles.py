"""Exact order statistics and quantiles by radix counting, one path for every size.

A single-task value map (Spark's exact ``percentile``) or a global sort does
not scale, so a wanted rank is found by counting. Each pass deals the values
that can still hold a rank to ``BUCKETS`` ordered buckets and counts them,
with the smallest and largest value of each; the bucket that holds the rank
becomes the next pass's interval. A pass is one partial aggregation: a task
sends at most ``BUCKETS`` rows per interval, whatever the data or its skew,
and the driver receives one row per wanted rank. A rank is settled when its
bucket holds one value only.

The first pass cuts the whole double range on a logarithmic scale, later ones
cut ``[smallest, largest]`` evenly; both maps never decrease, so buckets keep
the order of values. After the first pass an interval spans at most one
sixteenth of a binary order of magnitude, so three or four passes settle any rank.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import long_form, sql_clean, sql_lit

BUCKETS = 65536
MAX_FILTERS = 64        # intervals in one filter; with more of them a pass reads every value

# Logarithmic scale: the sign, then the binary exponent of the value.
_LOG = (f"CASE WHEN v = 0 THEN {BUCKETS // 2}L WHEN v > 0 THEN "
        f"{BUCKETS // 2 + 1}L + CAST(floor((log2(v) + 1080) / 2110 * {BUCKETS // 2 - 2}) AS BIGINT) ELSE "
        f"{BUCKETS // 2 - 1}L - CAST(floor((log2(-v) + 1080) / 2110 * {BUCKETS // 2 - 2}) AS BIGINT) END")
# Even scale over [lo, hi], halved first so that the width cannot overflow.
_EVEN = (f"CASE WHEN hi = lo THEN 0L ELSE "
         f"least(CAST(floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * {BUCKETS}) AS BIGINT), {BUCKETS - 1}L) END")


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    h = (n - 1) * p
    lo = int(math.floor(h))
    return lo, min(lo + 1, n - 1), h - lo


def _values(long_df: DataFrame, group_col: str, value_col: str) -> DataFrame:
    return (long_df.select(F.col(group_col).alias("g"), F.col(value_col).cast("double").alias("v"))
            .where("v IS NOT NULL AND NOT isnan(v)"))


def _first_counts(values: DataFrame) -> DataFrame:
    """(g, b, n, lo, hi): the logarithmic buckets of every group."""
    ends = (f"CASE WHEN v = CAST('Infinity' AS DOUBLE) THEN {BUCKETS}L "
            f"WHEN v = CAST('-Infinity' AS DOUBLE) THEN -1L ELSE {_LOG} END")
    return (values.groupBy("g", F.expr(ends).alias("b"))
            .agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))


def _narrow(counts: DataFrame, wanted: DataFrame, keys: list[str]) -> dict:
    """Per wanted rank ``(g, k)``: (lo, hi, rows below lo) of the bucket that holds it."""
    upto = Window.partitionBy(*keys).orderBy("b")
    found = (counts.withColumn("upto", F.sum("n").over(upto)).join(F.broadcast(wanted), keys)
             .where("r < upto AND r >= upto - n")
             .select("g", "k", "lo", "hi", (F.col("k") - F.col("r") + F.col("upto") - F.col("n")).alias("below")))
    return {(r["g"], r["k"]): (r["lo"], r["hi"], r["below"]) for r in found.collect()}


def _pass(values: DataFrame, state: dict, inside: Callable[[list], DataFrame] | None = None) -> dict:
    """One even counting pass: narrow every open rank ``(g, k)``, at (lo, hi, rows below lo), to a bucket.

    ``inside`` gives at least the values within ``(g, lo, hi)`` intervals, to be read instead of all ``values``.
    """
    spark = values.sparkSession
    open_ = {x: s for x, s in state.items() if s[0] != s[1]}
    # Ranks in one interval share its counts; both tables have a row per wanted rank at most.
    spans = sorted({(g, *s) for (g, _), s in open_.items()})
    number = {s: i for i, s in enumerate(spans)}
    if inside and len(spans) <= MAX_FILTERS:
        values = inside([s[:3] for s in spans])
    intervals = spark.createDataFrame([(i, g, float(lo), float(hi)) for i, (g, lo, hi, _) in enumerate(spans)],
                                      "i INT, g STRING, lo DOUBLE, hi DOUBLE")
    wanted = spark.createDataFrame([(number[(g, *s)], g, k, k - s[2]) for (g, k), s in open_.items()],
                                   "i INT, g STRING, k LONG, r LONG")
    counts = (values.join(F.broadcast(intervals), "g").where("v >= lo AND v <= hi")
              .select("i", F.expr(_EVEN).alias("b"), "v")
              .groupBy("i", "b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    return {**state, **_narrow(counts, wanted, ["i"])}


def _select(values: DataFrame, counts: DataFrame, ranks: set[tuple[str, int]],
            inside: Callable[[list], DataFrame] | None = None) -> dict:
    if not ranks:
        return {}
    wanted = values.sparkSession.createDataFrame([(g, k, k) for g, k in ranks], "g STRING, k LONG, r LONG")
    state = _narrow(counts, wanted, ["g"])
    while any(lo != hi for lo, hi, _ in state.values()):
        state = _pass(values, state, inside)
    return {x: (lo, below) for x, (lo, _, below) in state.items()}


def select_ranks(long_df: DataFrame, wanted: set[tuple[str, int]], group_col: str = "g",
                 value_col: str = "v") -> dict[tuple[str, int], tuple[float, int]]:
    """Exact order statistics: ``{(group, k): (value at 0-based rank k, rows with smaller values)}``.

    NULL and NaN are not values; ±Inf are the ends of the range.
    """
    values = _values(long_df, group_col, value_col)
    return _select(values, _first_counts(values), wanted)


def exact_quantiles(long_df: DataFrame, probs: list[float], group_col: str = "column", value_col: str = "value",
                    inside: Callable[[list], DataFrame] | None = None) -> dict[tuple[str, float], float | None]:
    """Exact linear-interpolated quantiles per group of a long-form table.

    ``long_df`` holds ``(group_col, value_col)`` rows; NULL and NaN are
    ignored. Returns ``{(group, p): value}`` (absent groups have no value).
    ``inside(intervals)`` may give the rows of ``(group, lo, hi)`` intervals faster than the whole table does.
    """
    values = _values(long_df, group_col, value_col)
    counts = _first_counts(values).persist()        # at most BUCKETS rows per group
    try:
        sizes = {r["g"]: r["n"] for r in counts.groupBy("g").agg(F.sum("n").alias("n")).collect()}
        plan = {(g, p): _ranks(n, p) for g, n in sizes.items() for p in probs}
        rows_in = inside and (lambda spans: _values(inside(spans), group_col, value_col))
        got = _select(values, counts, {(g, k) for (g, _), ks in plan.items() for k in ks[:2]}, rows_in)
    finally:
        counts.unpersist()
    out: dict[tuple[str, float], float | None] = {}
    for (g, p), (k1, k2, frac) in plan.items():
        a, b = got[(g, k1)][0], got[(g, k2)][0]
        # Weighted ends, as SQL engines interpolate.
        out[(g, p)] = a if frac == 0 or a == b else (1 - frac) * a + frac * b
    return out


def quantiles_frame(spark, result: dict[tuple[str, float], float | None], names: dict[float, str],
                    group_name: str = "column") -> DataFrame:
    """Small DataFrame ``(group, <name per p>...)`` from :func:`exact_quantiles`."""
    groups = sorted({g for g, _ in result})
    probs = sorted(names)
    rows = [(g, *[result[(g, p)] for p in probs]) for g in groups]
    schema = f"{group_name} STRING, " + ", ".join(f"{names[p]} DOUBLE" for p in probs)
    return spark.createDataFrame(rows, schema)


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[tuple[str, float], float | None]:
    """Exact linear quantiles of wide numeric columns (NULL and NaN ignored).

    After the first pass, rows without a value in an open interval are dropped before they are unpivoted.
    """
    if not columns:
        return {}

    def inside(spans):
        near = " OR ".join(f"CAST({sql_clean(df, c)} AS DOUBLE) BETWEEN {sql_lit(lo)} AND {sql_lit(hi)}"
                           for c, lo, hi in spans)
        return long_form(df.where(near), [c for c in columns if c in {g for g, *_ in spans}], "double")
    got = exact_quantiles(long_form(df, columns, "double"), probs, inside=inside)
    return {(c, p): got.get((c, p)) for c in columns for p in probs}
