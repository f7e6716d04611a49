"""Run log and catalog tables, as append-only event tables.

The reference keeps experiments and datasets in a relational store and
updates rows in place. On Spark the same information is an append-only
event table; "current state" is an aggregate over it (``max_by`` per run,
map-side combined, so a run with very many events is not a hot window),
status rules are checked against the previous event of the same run,
and catalog look-ups are filters, joins and ordered pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import pages
from tabloom.functions.ranking import previous_in_order

# Fixed values of the reference behaviour.
PENDING, RUNNING, COMPLETED, FAILED = "pending", "running", "completed", "failed"
TERMINAL = (COMPLETED, FAILED)
ERROR_SEPARATOR = "; "
PAGE_DEFAULT, PAGE_MAX = 20, 200


def is_terminal(status):
    return status.isin(*TERMINAL)


def run_events_from_activity(events: DataFrame, n_datasets: int = 25) -> DataFrame:
    """Map an activity table to run events: ``(run_id, seq, ts, status,
    dataset_id, message)``. signup/view → pending, click → running,
    purchase → completed, error → failed (message = the event's props)."""
    et = F.col("event_type")
    status = (F.when(et.isin("signup", "view"), PENDING).when(et == "click", RUNNING)
              .when(et == "purchase", COMPLETED).when(et == "error", FAILED))
    return events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "ts",
                         status.alias("status"),
                         (F.col("user_id") % n_datasets).cast("int").alias("dataset_id"),
                         F.when(et == "error", F.col("props")).alias("message"))


def transition_checks(run_events: DataFrame) -> DataFrame:
    """Each event with ``prev_status`` and ``valid``: a run starts pending;
    running is allowed only from pending; completed / failed from anywhere."""
    x = previous_in_order(run_events, ["run_id"], "seq", ["status"])
    s, p = F.col("status"), F.col("prev_status")
    valid = (F.when(p.isNull(), s == PENDING)
             .when(s == RUNNING, p == PENDING)
             .when(is_terminal(s), F.lit(True))
             .otherwise(F.lit(False)))
    return x.withColumn("valid", valid)


def run_transitions_valid(run_events: DataFrame) -> DataFrame:
    """``(run_id, n_events, n_invalid, valid)`` per run."""
    return (transition_checks(run_events).groupBy("run_id")
            .agg(F.count(F.lit(1)).alias("n_events"), F.count_if(~F.col("valid")).alias("n_invalid"))
            .withColumn("valid", F.col("n_invalid") == 0))


def run_latest_state(run_events: DataFrame) -> DataFrame:
    """Current record per run: ``(run_id, dataset_id, status, created_at,
    started_at, completed_at, error_message, n_events)``; started / completed
    times are those of the last running / terminal event (they are
    overwritten on every such transition)."""
    s = F.col("status")
    return run_events.groupBy("run_id").agg(
        F.min_by("dataset_id", "seq").alias("dataset_id"),
        F.max_by("status", "seq").alias("status"),
        F.min("ts").alias("created_at"),
        F.max(F.when(s == RUNNING, F.col("ts"))).alias("started_at"),
        F.max(F.when(is_terminal(s), F.col("ts"))).alias("completed_at"),
        F.max_by(F.col("message"), F.when(F.col("message").isNotNull(), F.col("seq")))
        .alias("error_message"),
        F.count(F.lit(1)).alias("n_events"))


def runs_by_status(latest: DataFrame, statuses: tuple[str, ...] = TERMINAL) -> DataFrame:
    return latest.where(F.col("status").isin(*statuses)).select("run_id", "status")


def run_counts(latest: DataFrame) -> DataFrame:
    """``(dataset_id, n_runs)``."""
    return latest.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_runs"))


def dataset_catalog(datasets: DataFrame, run_events: DataFrame) -> DataFrame:
    """``(dataset_id, name, created_at)``: a dataset appears when its first run does."""
    first = run_events.groupBy("dataset_id").agg(F.min("ts").alias("created_at"))
    return datasets.join(first, "dataset_id", "left").select("dataset_id", "name", "created_at")


def page(df: DataFrame, order: list[tuple[str, bool]], skip: int = 0, limit: int = PAGE_DEFAULT) -> DataFrame:
    """One page of a table in ``order``, a list of (column, descending); skip >= 0, 1 <= limit <= 200.

    Deep pages are located by counting (``functions.pages``), so no task
    holds all the rows before the page.
    """
    if skip < 0 or not 1 <= limit <= PAGE_MAX:
        raise ValueError("skip must be >= 0 and limit within 1..200")
    return pages.page(df, order, skip, limit)


def page_newest(catalog: DataFrame, skip: int = 0, limit: int = PAGE_DEFAULT) -> DataFrame:
    """Newest first; datasets without a time come last."""
    return page(catalog, [("created_at", True), ("dataset_id", False)], skip, limit)


def runs_by_dataset(latest: DataFrame, dataset_id: int, skip: int = 0,
                    limit: int = PAGE_DEFAULT) -> DataFrame:
    rows = latest.where(F.col("dataset_id") == dataset_id)
    return page(rows, [("created_at", True), ("run_id", False)], skip, limit).select(
        "run_id", "dataset_id", "status", "created_at")


def first_by_name(catalog: DataFrame, name: str) -> DataFrame:
    return catalog.where(F.col("name") == name).orderBy("dataset_id").limit(1)


def run_with_dataset(latest: DataFrame, catalog: DataFrame) -> DataFrame:
    """Runs with their dataset (inner join on the foreign key); AQE broadcasts
    the catalog side if its measured size allows."""
    return latest.join(catalog.select("dataset_id", "name"), "dataset_id").select("run_id", "dataset_id", "name", "status")


def orphan_runs(latest: DataFrame, catalog: DataFrame) -> DataFrame:
    """Foreign-key check: runs whose dataset does not exist (should be empty)."""
    return latest.join(catalog, "dataset_id", "left_anti")


def runs_after_delete(latest: DataFrame, deleted: DataFrame) -> DataFrame:
    """Cascade: runs of deleted datasets disappear (anti join on dataset_id)."""
    return latest.join(deleted.select("dataset_id"), "dataset_id", "left_anti").select("run_id", "dataset_id", "status")


def dataset_latest(patches: DataFrame) -> DataFrame:
    """Latest value of each field per dataset from partial patches
    ``(dataset_id, version, name, description)``; NULL = field not given."""
    return patches.groupBy("dataset_id").agg(
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("version"))).alias("name"),
        F.max_by("description", F.when(F.col("description").isNotNull(), F.col("version")))
        .alias("description"),
        F.max("version").alias("version"))


def stage_timeline(run_events: DataFrame) -> DataFrame:
    """``(run_id, seq, stage, status, duration_seconds, error)``: each event
    closes a stage that started at the previous event of the same run."""
    x = previous_in_order(run_events, ["run_id"], "seq", ["ts"])
    dur = F.coalesce(F.timestamp_diff("MICROSECOND", F.col("prev_ts"), F.col("ts")),
                     F.lit(0)) / 1e6
    return x.select("run_id", "seq", F.col("status").alias("stage"),
                    F.when(F.col("status") == FAILED, "error").otherwise("success").alias("status"),
                    F.round(dur, 3).alias("duration_seconds"), F.col("message").alias("error"))


def run_errors(run_events: DataFrame) -> DataFrame:
    """``(run_id, errors)``: all of the run's error messages, repeats kept, in
    order of ``seq`` and joined with "; ". The text of a run is as long as its
    errors; nothing but error events is gathered."""
    found = run_events.where(F.col("message").isNotNull())
    return found.groupBy("run_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "message"))), lambda s: s["message"]),
        ERROR_SEPARATOR).alias("errors"))


def run_outcome(run_events: DataFrame) -> DataFrame:
    """``(run_id, outcome, n_errors)``: any failed stage makes the run failed."""
    return run_events.groupBy("run_id").agg(
        F.when(F.bool_or(F.col("status") == FAILED), FAILED).otherwise(COMPLETED).alias("outcome"),
        F.count_if(F.col("status") == FAILED).alias("n_errors"))


def registration_row(df: DataFrame, name: str | None = None, source: str | None = None) -> DataFrame:
    """Dataset registration: ``(name, n_rows, n_cols, columns)`` where columns lists ``name:label`` in table order.

    With the ``source`` folder or file also ``file_path`` and ``n_bytes`` (the
    size of its files, not read); the name is then the file's stem unless given.
    """
    from tabloom.functions.columns import column_labels
    from tabloom.sources.csv_ingest import dataset_name
    labels = [f"{c}:{t}" for c, t in column_labels(df).items()]
    if name is None:
        if source is None:
            raise ValueError("a table without a source needs a name")
        name = dataset_name(source)[0]
    out = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_cols"),
        F.array(*[F.lit(x) for x in labels]).alias("columns"))
    if source is None:
        return out
    size = (df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
            .select("length").agg(F.coalesce(F.sum("length"), F.lit(0).cast("long"))).first()[0])
    return out.withColumns({"file_path": F.lit(source), "n_bytes": F.lit(size).cast("long")})
