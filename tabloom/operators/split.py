"""Reproducible train/test split with exact sizes.

Rows are ordered by ``md5("<seed>:" || key)``; the first ``int(n * 0.8)``
are train. ``randomSplit`` cannot give exact sizes, and a global
``row_number()`` would sort every row in one task. Instead the boundary is
found by radix counting (:mod:`tabloom.functions.quantiles`) over the first 52
bits of the hash, and the split is a per-row comparison with it. Rows that
share the boundary, because keys repeat, are ordered by a hash of the whole
row in the same way; rows that are equal in whole are dealt by count. Sizes
are exact whatever the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.columns import col
from tabloom.functions.quantiles import select_ranks

# Fixed values of the reference behaviour.
TEST_SIZE = 0.2
SEED = 42
MIN_ROWS_FOR_SPLIT = 20


def _hash(key: str, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))


def _boundary(df: DataFrame, order: str, n_train: int) -> tuple[float, int]:
    """(value of ``order`` at the last train row, train rows among those that share it)."""
    v, below = select_ranks(df.select(F.lit("all").alias("g"), F.col(order).alias("v")),
                            {("all", n_train - 1)})[("all", n_train - 1)]
    return v, n_train - below


def assign_split(df: DataFrame, key: str, test_size: float = TEST_SIZE, seed: int = SEED,
                 part_col: str = "part") -> DataFrame:
    """Add ``part`` = 'train' / 'test'. Fewer than 20 rows: every row is
    returned twice, once per part (train = test = all)."""
    n = df.count()
    if n < MIN_ROWS_FOR_SPLIT:
        both = F.explode(F.array(F.lit("train"), F.lit("test")))
        return df.select("*", both.alias(part_col))
    n_train = int(n * (1 - test_size))
    first = F.conv(F.substring(_hash(key, seed), 1, 13), 16, 10).cast("bigint").cast("double")
    # Second order, used among rows of the boundary value only.
    row = F.pmod(F.xxhash64(F.lit(seed), *[col(c) for c in df.columns]), F.lit(1 << 52)).cast("double")
    hashed = df.select("*", first.alias("_o"), row.alias("_r"))
    if n_train == 0:
        return hashed.withColumn(part_col, F.lit("test")).drop("_o", "_r")
    v, take = _boundary(hashed, "_o", n_train)
    edge = hashed.where(F.col("_o") == v)
    if take == edge.count():
        train = F.col("_o") <= v
        return hashed.withColumn(part_col, F.when(train, "train").otherwise("test")).drop("_o", "_r")
    w, take = _boundary(edge, "_r", take)
    train = (F.col("_o") < v) | ((F.col("_o") == v) & (F.col("_r") < w))
    tied = (F.col("_o") == v) & (F.col("_r") == w)
    sure = (hashed.where(~tied).withColumn(part_col, F.when(train, "train").otherwise("test"))
            .drop("_o", "_r"))
    # Equal rows: one row per distinct row with its count, of which the first ``take`` go to train.
    groups = hashed.where(tied).groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy(*[col(c) for c in df.columns]))
    dealt = groups.withColumn("_t", F.greatest(F.least(F.lit(take) - (upto - F.col("_n")), F.col("_n")), F.lit(0)))
    parts = F.concat(F.array_repeat(F.lit("train"), F.col("_t").cast("int")),
                     F.array_repeat(F.lit("test"), (F.col("_n") - F.col("_t")).cast("int")))
    return sure.unionByName(dealt.select(*[col(c) for c in df.columns], F.explode(parts).alias(part_col)))


def train_test_split(df: DataFrame, key: str, test_size: float = TEST_SIZE,
                     seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    labelled = assign_split(df, key, test_size, seed)
    train = labelled.where(F.col("part") == "train").drop("part")
    test = labelled.where(F.col("part") == "test").drop("part")
    return train, test


def split_partition_check(df: DataFrame, train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """``(check, n)``: sizes, key overlap (intersect) and keys lost (exceptAll)."""
    k = [col(key)]
    both = train.select(*k).unionByName(test.select(*k))
    rows = [
        df.select(F.lit("n_total").alias("check"), F.count(F.lit(1)).alias("n")),
        train.select(F.lit("n_train").alias("check"), F.count(F.lit(1)).alias("n")),
        test.select(F.lit("n_test").alias("check"), F.count(F.lit(1)).alias("n")),
        train.select(*k).intersect(test.select(*k)).select(
            F.lit("n_overlap").alias("check"), F.count(F.lit(1)).alias("n")),
        df.select(*k).exceptAll(both).select(F.lit("n_missing").alias("check"),
                                             F.count(F.lit(1)).alias("n")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
