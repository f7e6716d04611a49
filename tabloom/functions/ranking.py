"""Distributed ranking helpers: salted top-k per group and running sums.

A window without ``partitionBy`` (or partitioned by a hot key) moves all
its rows into one task. The helpers here split that work: top-k is taken
first inside salted sub-groups and again over the k·S survivors, and
running sums are computed inside range partitions plus a small offset table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.session import cut_lineage

SALT_BUCKETS = 64


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    salt_on: Column, rank_name: str = "rk",
                    salt_buckets: int = SALT_BUCKETS) -> DataFrame:
    """Top ``k`` rows per group in ``order``, with rank column ``rank_name``.

    Stage 1 ranks inside ``(group, hash(salt_on) % salt_buckets)`` so a
    group with many rows is spread over ``salt_buckets`` tasks; stage 2
    ranks at most ``k * salt_buckets`` rows per group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    stage1 = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return (stage1.withColumn(rank_name, F.row_number().over(w2))
            .where(F.col(rank_name) <= k).drop("_salt", "_r1"))


def running_sums(df: DataFrame, order_col: str, sum_cols: list[str],
                 partition_cols: list[str] | None = None, bucket_rows: int = 1_000_000) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over rows with a smaller ``order_col``
    (exclusive, missing values last), per ``partition_cols``.

    ``df`` should already be aggregated to one row per distinct
    ``(partition_cols, order_col)``, and be persisted by its owner: it is read
    three times. Rows are staged in range partitions of about ``bucket_rows``
    rows each; a partition gets its offset from a table of partition totals,
    and a window inside the partition adds the rest. Spark samples the range
    borders, a bounded number of rows whatever the table's size.
    """
    parts = partition_cols or []
    order = F.col(order_col).asc_nulls_last()
    n_ranges = max(1, -(-df.count() // bucket_rows))
    ranged = cut_lineage(df.repartitionByRange(n_ranges, *parts, order)
                         .withColumn("_range", F.spark_partition_id()))
    tot = ranged.groupBy(*parts, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    wb = Window.partitionBy(*parts).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tot.select(*parts, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_o_{c}")
                                             for c in sum_cols])
    wi = Window.partitionBy(*parts, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.select("*", *[F.coalesce(F.sum(c).over(wi), F.lit(0)).alias(f"_i_{c}") for c in sum_cols])
    out = inner.join(offsets, [*parts, "_range"])
    return out.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_i_{c}")).alias(f"cum_{c}") for c in sum_cols])


def previous_in_order(df: DataFrame, keys: list[str], order_col: str, cols: list[str],
                      bucket_width: int = 1_000_000, prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>``: the value of ``c`` on the previous row of the same
    key in ``order_col`` order (NULL for the first row of a key).

    A plain ``lag`` over ``partitionBy(keys)`` sorts all rows of a key in
    one task; with a key holding a third of the table that task is the job.
    Here rows are cut into (key, order bucket) windows of at most
    ``bucket_width`` order values each; the first row of each bucket takes
    its predecessor from a small per-bucket "last row" table (one row per
    non-empty bucket) instead of from a global sort. ``order_col`` must be
    an integral, unique-per-key column.
    """
    b = F.floor(F.col(order_col) / F.lit(bucket_width)).alias("_b")
    x = df.withColumn("_b", b)
    w_in = Window.partitionBy(*keys, "_b").orderBy(order_col)
    x = x.select("*", *[F.lag(c).over(w_in).alias(f"_lag_{c}") for c in cols],
                 F.row_number().over(w_in).alias("_rn"))
    last = x.groupBy(*keys, "_b").agg(
        F.max_by(F.struct(*[F.col(c).alias(c) for c in cols]), F.col(order_col)).alias("_last"))
    w_b = Window.partitionBy(*keys).orderBy("_b")
    carry = last.select(*keys, "_b", F.lag("_last").over(w_b).alias("_carry"))
    j = x.join(carry, [*keys, "_b"], "left")
    out = j.select(*df.columns, *[F.when(F.col("_rn") == 1, F.col("_carry")[c])
                                  .otherwise(F.col(f"_lag_{c}")).alias(f"{prefix}{c}")
                                  for c in cols])
    return out
