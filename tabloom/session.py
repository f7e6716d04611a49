"""Session helpers: shared confs and a reliable checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Confs the library relies on. AQE coalesces small shuffles and splits
# skewed join partitions at run time; UTC keeps timestamp text stable.
DEFAULT_CONFS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.scheduler.mode": "FAIR",      # models fitted at the same time share the cores
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "tabloom",
                  shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """Session for tests, bench and local runs."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in {**DEFAULT_CONFS, **extra}.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", extra.get("spark.driver.memory", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used as is. Only a
    local-mode session without that setting (tests, laptops) gets a fresh
    scratch folder; on a cluster an unset folder is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tabloom-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df):
    """Materialise ``df`` in the reliable checkpoint folder (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_columns(df):
    """Write ``df`` as Parquet to the checkpoint folder and read it back: lineage cut, columns packed and read singly."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/columns/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
