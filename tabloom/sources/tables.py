"""Driver Parquet tables and the inputs derived from them.

Each derived input is a lazy DataFrame over whole tables; Catalyst pushes
the column selection into each Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with deterministic gaps, a sparse column, outliers and
    repeated rows, so the cleaning operators have work to do.

    Every row whose order key is a multiple of 97 comes twice (exact duplicates
    for deduplication); the whole table is read, once.
    """
    li = load(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    shaped = li.select(
        "l_orderkey", "l_linenumber",
        F.when(k % 11 == 0, F.lit(None).cast("double"))
         .when(k % 503 == 0, F.col("l_extendedprice") * 100)
         .otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_partkey") % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("l_returnflag")).alias("flag"),
        F.when(k % 10 < 7, F.lit(None).cast("double")).otherwise(F.col("l_tax")).alias("sparse"),
        F.when(F.col("l_suppkey") % 13 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("l_linestatus")).alias("target"),
    )
    copies = F.when(k % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return shaped.withColumn("_copy", F.explode(copies)).drop("_copy")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order line summary (partial aggregation before the shuffle)."""
    li = load(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.avg("l_discount").alias("avg_discount"),
        F.sum("l_quantity").alias("sum_qty"),
    )


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modelling table: orders ⋈ customer ⋈ nation ⟕ line summary.

    Orders without lines keep NULL line features (natural gaps).
    ``o_orderstatus`` is the class target, ``o_totalprice`` the numeric one.
    Join strategy is left to the planner: nation is tiny and broadcast by
    size statistics; customer and the line summary grow with the data and
    are joined by shuffle on their keys.
    """
    o = load(spark, sf_dir, "orders")
    c = load(spark, sf_dir, "customer")
    n = load(spark, sf_dir, "nation")
    lines = order_lines(spark, sf_dir)
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, c.c_nationkey == n.n_nationkey)
             .join(lines, o.o_orderkey == lines.l_orderkey, "left")
             .select("o_orderkey", "o_orderpriority", "o_totalprice", "c_acctbal",
                     "c_mktsegment", "n_name", "n_lines", "avg_discount", "sum_qty",
                     "o_orderstatus"))


def binary_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deterministic rule models scored against ``labels.quality``:
    ``(model, doc_id, y, pred, score)``. They stand in for fitted models so
    that every metric has an exact SQL oracle."""
    lab = load(spark, sf_dir, "labels")
    docs = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = lab.join(docs, "doc_id")
    y = F.col("quality")
    length_rule = j.select(F.lit("length_rule").alias("model"), "doc_id", y.alias("y"),
                           (F.col("n_chars") >= 1000).cast("int").alias("pred"),
                           (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"))
    hash_rule = j.select(F.lit("hash_rule").alias("model"), "doc_id", y.alias("y"),
                         (F.col("doc_id") % 3 == 0).cast("int").alias("pred"),
                         ((F.col("doc_id") * 7919 % 1000) / 1000.0).alias("score"))
    toxic_rule = j.select(F.lit("toxic_rule").alias("model"), "doc_id", y.alias("y"),
                          (1 - F.col("toxic")).alias("pred"),
                          F.when(F.col("toxic") == 1, 0.25).otherwise(0.75).alias("score"))
    return length_rule.unionByName(hash_rule).unionByName(toxic_rule)


def multiclass_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule model for ``o_orderstatus`` (F/O/P) scored by the shares of an
    order's lines with return flag A/N/R: ``(model, o_orderkey, y, pred, p_F, p_O, p_P)``."""
    li = load(spark, sf_dir, "lineitem")
    shares = li.groupBy("l_orderkey").agg(
        F.avg((F.col("l_returnflag") == "A").cast("double")).alias("p_F"),
        F.avg((F.col("l_returnflag") == "N").cast("double")).alias("p_O"),
        F.avg((F.col("l_returnflag") == "R").cast("double")).alias("p_P"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    j = o.join(shares, o.o_orderkey == shares.l_orderkey)
    pred = (F.when((F.col("p_F") >= F.col("p_O")) & (F.col("p_F") >= F.col("p_P")), "F")
            .when(F.col("p_O") >= F.col("p_P"), "O").otherwise("P"))
    return j.select(F.lit("flag_share").alias("model"), "o_orderkey",
                    F.col("o_orderstatus").alias("y"), pred.alias("pred"), "p_F", "p_O", "p_P")


def regression_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rule models for ``o_totalprice`` from the order's lines:
    ``(model, o_orderkey, y, pred)``, in thousands. At raw scale the MSE is
    ~1e10, where 4 decimals are below double precision and two engines
    summing in different orders disagree in the last printed digit."""
    li = load(spark, sf_dir, "lineitem")
    sums = li.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
        .alias("line_sum"),
        F.sum("l_extendedprice").alias("gross_sum"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    j = o.join(sums, o.o_orderkey == sums.l_orderkey)
    y = (F.col("o_totalprice") / 1000.0).alias("y")
    return (j.select(F.lit("line_sum").alias("model"), "o_orderkey", y,
                     (F.col("line_sum") / 1000.0).alias("pred"))
            .unionByName(j.select(F.lit("gross_sum").alias("model"), "o_orderkey", y,
                                  (F.col("gross_sum") / 1000.0).alias("pred"))))


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run events derived from ``events`` (see runlog.run_events_from_activity)."""
    from tabloom.operators.runlog import run_events_from_activity
    return run_events_from_activity(load(spark, sf_dir, "events"))


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset catalog: one dataset per nation."""
    n = load(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("dataset_id"), F.col("n_name").alias("name"),
                    "n_regionkey")


def dataset_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial updates of dataset name / description, one per event:
    ``(dataset_id, version, name, description)`` with NULL = field not given."""
    e = load(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 25).cast("int").alias("dataset_id"),
                    F.col("event_id").alias("version"),
                    F.when(F.col("value") > 50, F.concat(F.lit("ds_"), F.col("event_id")))
                    .alias("name"),
                    F.when(F.col("value") <= 80, F.col("props")).alias("description"))


def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents for quality classification:
    ``(doc_id, n_chars, n_lines, lang, source, toxic, quality)``."""
    d = load(spark, sf_dir, "documents")
    lab = load(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        "doc_id", "n_chars", (F.size(F.split(F.col("text"), "\n"))).alias("n_lines"),
        "lang", "source", "toxic", "quality")
