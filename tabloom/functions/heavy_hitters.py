"""Most frequent values without shuffling all values.

Every task keeps a bounded summary of each column: counts of at most
``capacity`` values, lowered together whenever there are more, and the sum of
those cuts. A value's true count lies between its summed counts and that plus
the summed cuts, so the summaries tell candidates and a bound on all others.
The candidates are counted exactly in a second pass. If the k-th of them is
commoner than any value left out can be, the top k are proven; only columns
without that proof are counted in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import long_form, sql_clean
from tabloom.functions.ranking import top_k_per_group

CAPACITY = 1024             # values per column in a task's summary
RECOUNTED = 4096            # candidates per column that are counted exactly


def trimmed(counts: dict, capacity: int) -> int:
    """Lower all counts by the (capacity + 1)-th largest, drop what is used up; returns the cut."""
    if len(counts) <= capacity:
        return 0
    cut = sorted(counts.values(), reverse=True)[capacity]
    for v in [v for v, n in counts.items() if n <= cut]:
        del counts[v]
    for v in counts:
        counts[v] -= cut
    return cut


def summaries(df: DataFrame, columns: list[str], capacity: int = CAPACITY) -> DataFrame:
    """(c, value, n): counts of each task's summary; under a null value the cut of the task."""
    wide = df.selectExpr(*[f"CAST({sql_clean(df, c)} AS STRING) AS _v{i}" for i, c in enumerate(columns)])

    def run(batches):
        import pyarrow as pa
        counts, cuts = [{} for _ in columns], [0] * len(columns)
        for b in batches:
            for i, column in enumerate(b.columns):
                found = column.drop_null().value_counts()
                own = counts[i]
                for v, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist()):
                    own[v] = own.get(v, 0) + n
                cuts[i] += trimmed(own, capacity)
        for i, own in enumerate(counts):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * (len(own) + 1), pa.int32()), pa.array([None, *own], pa.string()),
                 pa.array([cuts[i], *own.values()], pa.int64())], names=["c", "value", "n"])
    return wide.mapInArrow(run, "c int, value string, n long").groupBy("c", "value").agg(F.sum("n").alias("n"))


def top_counts(df: DataFrame, columns: list[str], k: int, capacity: int = CAPACITY,
               recounted: int = RECOUNTED) -> DataFrame:
    """``(column, value, n, rk)``: the k most frequent values (as text) of each column, ties by value.

    Missing values do not count; a column without a value has no row.
    """
    spark = df.sparkSession
    schema = "column STRING, value STRING, n BIGINT, rk INT"
    if not columns:
        return spark.createDataFrame([], schema)
    found = summaries(df, columns, capacity).persist()
    try:
        cut = {r["c"]: r["n"] for r in found.where("value IS NULL").collect()}          # one row per column
        order = [F.desc("n"), F.asc("value")]
        best = top_k_per_group(found.where("value IS NOT NULL"), ["c"], order, recounted + 1, F.col("value"), "r").collect()
    finally:
        found.unpersist()
    known = {i: [] for i in range(len(columns))}        # at most ``recounted`` + 1 rows per column
    for r in sorted(best, key=lambda r: r["r"]):
        known[r["c"]].append((r["value"], r["n"]))
    sure, doubtful = {}, {}
    for i, values in known.items():
        if not cut[i]:
            sure[i] = values[:k]                        # no task left anything out
        elif values:
            # What is not recounted has at most its own count, or the first left out's, and all cuts.
            doubtful[i] = (values[:recounted], cut[i] + (values[recounted][1] if len(values) > recounted else 0))
    full = []
    if doubtful:
        wanted = spark.createDataFrame([(columns[i], v) for i, (vs, _) in doubtful.items() for v, _ in vs],
                                       "column STRING, value STRING")
        long = long_form(df, [columns[i] for i in doubtful], "string").where("value IS NOT NULL")
        # Bounded: ``recounted`` values per column.
        exact = long.join(F.broadcast(wanted), ["column", "value"]).groupBy("column", "value").agg(F.count("*").alias("n"))
        by: dict[str, list] = {}
        for r in exact.collect():
            by.setdefault(r["column"], []).append((r["value"], r["n"]))
        for i, (_, bound) in doubtful.items():
            ranked = sorted(by.get(columns[i], []), key=lambda x: (-x[1], x[0].encode()))[:k]
            if len(ranked) == k and ranked[-1][1] > bound:
                sure[i] = ranked
            else:
                full.append(columns[i])
    rows = [(columns[i], v, n, rk) for i, vs in sure.items() for rk, (v, n) in enumerate(vs, 1)]
    out = spark.createDataFrame(rows, schema)
    if full:
        long = long_form(df, full, "string").where("value IS NOT NULL")
        counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
        out = out.unionByName(top_k_per_group(counts, ["column"], [F.desc("n"), F.asc("value")], k, F.col("value"), "rk"))
    return out
