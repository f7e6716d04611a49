"""A stored run log, laid out for those who read the current state of runs.

Events are appended in numbered batches, one Parquet folder each. Beside them
lies the state, one row per run, bucketed and sorted by ``run_id``: reading the
latest state is a scan, and joins and aggregates by run need no exchange. A run
with very many events is one row of it, so no bucket grows with a run's events.
An append aggregates the new events only and merges them into the state by a
join that shuffles the new side alone, into the next version of the state.

The versions table gets its row last. Until then readers see the version
before; an append that failed half-way is repeated whole and writes over what
it left. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.columns import q, sql_lit
from tabloom.operators.runlog import RUNNING, is_terminal

BUCKETS = 64


class RunStore:
    """Run log ``name`` in the shared folder ``root``."""

    def __init__(self, spark: SparkSession, name: str, root: str, buckets: int = BUCKETS):
        self.spark, self.name, self.root, self.buckets = spark, name, root.rstrip("/"), buckets

    def version(self) -> int:
        """The number of complete appends."""
        try:
            done = self.spark.read.schema("version INT").parquet(f"{self.root}/versions")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0
        return done.agg(F.max("version")).first()[0] or 0

    def append(self, run_events: DataFrame) -> int:
        """Add events ``(run_id, seq, ts, status, dataset_id, message)``; returns the new version.

        ``seq`` orders a run's events over all appends, which may come in any
        order. Events without a ``run_id`` are kept, and are no run.
        """
        before = self.version()
        now = before + 1
        path = f"{self.root}/events/batch={now}"
        run_events.write.mode("overwrite").parquet(path)
        state = self._dealt(_summary(self.spark.read.parquet(path)))
        if before:
            state = _merge(self._state(before), state)
        (state.write.mode("overwrite").format("parquet").bucketBy(self.buckets, "run_id").sortBy("run_id")
         .option("path", self._folder(now)).saveAsTable(self._table(now)))
        self.spark.range(1).selectExpr(f"{now} AS version").write.mode("append").parquet(f"{self.root}/versions")
        return now

    def events(self) -> DataFrame:
        """All events of complete appends, with the number of their ``batch``."""
        return self.spark.read.parquet(f"{self.root}/events").where(F.col("batch") <= self._newest())

    def latest(self) -> DataFrame:
        """The rows of ``runlog.run_latest_state``, one per run, without an exchange."""
        s = self._state(self._newest())
        return s.select("run_id", F.col("first.dataset_id").alias("dataset_id"), F.col("last.status").alias("status"),
                        "created_at", "started_at", "completed_at", F.col("error.message").alias("error_message"),
                        "n_events")

    def _newest(self) -> int:
        if not (v := self.version()):
            raise ValueError(f"nothing has been appended to {self.root}")
        return v

    def _dealt(self, state: DataFrame) -> DataFrame:
        """As the buckets are, so that the old state stays where it lies and a task writes one file."""
        return state.repartition(self.buckets, "run_id")

    def _table(self, version: int) -> str:
        return q(f"{self.name}_state_{version}")

    def _folder(self, version: int) -> str:
        return f"{self.root}/state/version={version}"

    def _state(self, version: int) -> DataFrame:
        """The table of a version; a session that has not seen it registers its buckets first."""
        table = self._table(version)
        if not self.spark.catalog.tableExists(table):
            columns = self.spark.read.parquet(self._folder(version)).schema.toDDL()
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (run_id) SORTED BY (run_id) "
                           f"INTO {self.buckets} BUCKETS LOCATION {sql_lit(self._folder(version))}")
        return self.spark.table(table)


def _summary(run_events: DataFrame) -> DataFrame:
    """One mergeable row per run. Smallest and largest (seq, value) pairs stand for first and last values."""
    s = F.col("status")
    return run_events.where("run_id IS NOT NULL").groupBy("run_id").agg(
        F.min(F.struct("seq", "dataset_id")).alias("first"),
        F.max(F.struct("seq", "status")).alias("last"),
        F.min("ts").alias("created_at"),
        F.max(F.when(s == RUNNING, F.col("ts"))).alias("started_at"),
        F.max(F.when(is_terminal(s), F.col("ts"))).alias("completed_at"),
        F.max(F.when(F.col("message").isNotNull(), F.struct("seq", "message"))).alias("error"),
        F.count(F.lit(1)).alias("n_events"))


def _merge(old: DataFrame, new: DataFrame) -> DataFrame:
    a, b = old.alias("a"), new.hint("merge").alias("b")

    def both(pick, name):
        return pick(F.col(f"a.{name}"), F.col(f"b.{name}")).alias(name)

    return a.join(b, F.col("a.run_id") == F.col("b.run_id"), "full").select(
        both(F.coalesce, "run_id"),
        both(F.least, "first"), both(F.greatest, "last"),
        both(F.least, "created_at"), both(F.greatest, "started_at"), both(F.greatest, "completed_at"),
        both(F.greatest, "error"),
        (F.coalesce("a.n_events", F.lit(0)) + F.coalesce("b.n_events", F.lit(0))).alias("n_events"))
