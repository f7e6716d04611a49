"""End-to-end run: plan → explore → clean → features → split → train →
evaluate → report, as one function over a DataFrame.

Each stage is timed and recorded. A planner error (bad target, unknown task)
stops the run; a failure in a later stage is recorded and the run goes on with
what it has. With ``output_root`` every stage writes its tables, fitted
parameters and models under ``<root>/<run_id>/`` and the run appends its
record and its stages to ``<root>/run_events`` and ``<root>/run_stages``.

Tables reused by several jobs are persisted and released when the run ends;
the modelling table is checkpointed to the cluster's reliable checkpoint
folder before the iterative model fits.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import CATEGORICAL, DATETIME, NUMERIC, column_labels, q
from tabloom.operators import chartdata, clean, encode, models, profile, rank, report, runlog, select, split
from tabloom.session import cut_lineage

DEFAULT_CONFIG = {
    "cleaning": {"drop_missing_threshold": clean.DROP_MISSING_THRESHOLD,
                 "iqr_multiplier": clean.IQR_MULTIPLIER, "clip_outliers": True,
                 "impute_missing": True},
    "feature_engineering": {"top_k_features": select.DEFAULT_TOP_K,
                            "ordinal_cardinality_threshold": encode.ORDINAL_CARDINALITY_THRESHOLD,
                            "drop_low_variance": True, "feature_selection": True,
                            "mi_estimator": "neighbours"},      # or "bins"
    "training": {"models": None, "forest_depth": models.FOREST_DEPTH,
                 "limit_seconds": None},      # per model
}
TASKS = ("classification", "regression")
KEY = "_row_key"

# Layout under ``<root>/<run_id>/``.
LAYOUT = {"cleaned": "cleaned", "features": "features", "transformer": "transformer", "models": "models",
          "eda": "eda", "leaderboard": "leaderboard", "report": "report"}


class PlanError(ValueError):
    pass


def utc_now() -> datetime:
    return datetime.now(timezone.utc)


@dataclass
class ExperimentResult:
    run_id: str
    task_type: str
    target: str
    root: str | None = None
    plan: DataFrame | None = None
    eda: dict = field(default_factory=dict)          # name -> table
    cleaning_report: dict = field(default_factory=dict)
    feature_model: encode.FeatureModel | None = None
    mi_scores: DataFrame | None = None
    selected_features: list[str] = field(default_factory=list)
    metrics: DataFrame | None = None
    leaderboard: DataFrame | None = None
    summary: DataFrame | None = None
    best_artifact: DataFrame | None = None
    report: DataFrame | None = None
    model_errors: dict = field(default_factory=dict)
    trained: list = field(default_factory=list)
    artifacts: dict = field(default_factory=dict)    # model -> path
    stages: list = field(default_factory=list)       # (stage, status, seconds, error)
    events: list = field(default_factory=list)       # (seq, status, utc time, message)
    errors: list = field(default_factory=list)
    warnings: list = field(default_factory=list)

    @property
    def status(self) -> str:
        return self.events[-1][1] if self.events else runlog.PENDING

    @property
    def structure(self) -> DataFrame | None:
        return self.eda.get("structure")

    def path(self, table: str) -> str:
        """Place of a table of this run."""
        return f"{self.root.rstrip('/')}/{self.run_id}/{LAYOUT.get(table, table)}"

    def record(self, status: str, message: str | None = None) -> None:
        """Append an event to the run's record."""
        self.events.append((len(self.events) + 1, status, utc_now(), message))

    def run_events(self, spark) -> DataFrame:
        rows = [(self.run_id, seq, s, t.replace(tzinfo=None), m) for seq, s, t, m in self.events]
        return spark.createDataFrame(rows, "run_id STRING, seq LONG, status STRING, ts TIMESTAMP_NTZ, "
                                           "message STRING").withColumn("ts", F.col("ts").cast("timestamp"))

    def timeline(self, spark) -> DataFrame:
        rows = [(self.run_id, i + 1, s, st, sec, err) for i, (s, st, sec, err) in
                enumerate(self.stages)]
        return spark.createDataFrame(rows, "run_id STRING, seq INT, stage STRING, status STRING, "
                                           "duration_seconds DOUBLE, error STRING")


def _merge(config: dict | None) -> dict:
    out = {k: (dict(v) if isinstance(v, dict) else v) for k, v in DEFAULT_CONFIG.items()}
    for k, v in (config or {}).items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k].update(v)
        else:
            out[k] = v
    return out


def datetimes_as_days(df: DataFrame, skip: tuple[str, ...]) -> DataFrame:
    """Date and time features as DOUBLE days since 1970-01-01, so that they enter scaling and models."""
    labels = column_labels(df)

    def days(c):
        if labels[c] != DATETIME or c in skip:
            return q(c)
        return f"unix_micros(CAST({q(c)} AS TIMESTAMP)) / 86400000000.0D AS {q(c)}"
    return df.selectExpr(*[days(c) for c in df.columns])


def explore(df: DataFrame, target: str, task: str, id_col: str | None = None) -> dict[str, DataFrame]:
    """The tables of the exploration stage: structure, correlations, target analysis, chart data
    of every numeric and every text column. All are small aggregates."""
    labels = column_labels(df)
    feats = [c for c in df.columns if c not in (target, id_col)]
    numeric = [c for c in feats if labels[c] == NUMERIC]
    text = [c for c in feats if labels[c] == CATEGORICAL]
    out = {"structure": profile.structure_report(df), "missing": profile.missing_report(df),
           "bytes": profile.payload_bytes(df)}
    if len(numeric) >= 2:
        out["correlation"] = profile.correlation_matrix(df, numeric)
        out["correlation_triangle"] = chartdata.corr_lower_triangle(df, numeric)
    if numeric:
        out["histogram"] = chartdata.histogram(df, numeric)
        out["kde"] = chartdata.kde_curve(df, numeric)
        out["box"] = chartdata.box_stats(df, numeric)
    if text:
        out["top_values"] = profile.top_values(df, text)
        out["bars"] = chartdata.category_bars(df, text)
    if task == "classification":
        out["class_balance"] = profile.class_balance(df, target)
    else:
        out["target_summary"] = profile.target_numeric_summary(df, target)
    out["target_distribution"] = chartdata.target_distribution(df, target, numeric=labels[target] == NUMERIC
                                                               and task == "regression")
    return out


def run_experiment(df: DataFrame, target: str, task_type: str | None = None,
                   config: dict | None = None, id_col: str | None = None,
                   output_root: str | None = None) -> ExperimentResult:
    cfg = _merge(config)
    spark = df.sparkSession
    if not target:
        raise PlanError("target column is required")
    if target not in df.columns:
        raise PlanError(f"target '{target}' not in table; columns: {df.columns[:10]}")
    res = ExperimentResult(run_id=uuid.uuid4().hex, task_type=task_type or "", target=target, root=output_root)
    res.record(runlog.PENDING)
    state: dict = {}
    held: list = []

    def sink(table: DataFrame, name: str) -> None:
        if output_root:
            table.write.mode("errorifexists").parquet(res.path(name))

    def stage(name, fn) -> bool:
        t0 = time.time()
        try:
            fn()
            res.stages.append((name, "success", round(time.time() - t0, 3), None))
            return True
        except Exception as exc:  # noqa: BLE001 - later stages record and continue
            msg = f"{name}: {type(exc).__name__}: {exc}"
            res.errors.append(msg)
            res.stages.append((name, "error", round(time.time() - t0, 3), msg))
            return False

    def do_plan():
        if task_type is not None and task_type not in TASKS:
            raise PlanError(f"unknown task type '{task_type}'; expected one of {TASKS}")
        detected = profile.detect_task_type(df, target)
        res.task_type = task_type or detected
        if res.task_type != detected:
            res.warnings.append(f"task type {res.task_type} requested; the target looks like {detected}")
        res.plan = profile.plan_profile(df, target, res.task_type)

    def do_eda():
        for name, table in explore(df, target, res.task_type, id_col).items():
            res.eda[name] = table.persist()
            held.append(table)
            table.count()
            sink(table, f"{LAYOUT['eda']}/{name}")

    def do_clean():
        c = cfg["cleaning"]
        cr = clean.clean_table(df, target, c["drop_missing_threshold"], c["iqr_multiplier"],
                               c["clip_outliers"], c["impute_missing"], key_col=KEY)
        held.append(cr.held)
        res.cleaning_report = cr.report
        state["clean"] = cr.table.persist()
        held.append(state["clean"])
        sink(state["clean"].drop(KEY), "cleaned")

    def do_features():
        fe = cfg["feature_engineering"]
        ids = tuple(c for c in (id_col, KEY) if c and c in state["clean"].columns)
        cleaned = datetimes_as_days(state["clean"], (*ids, target))
        fm = encode.fit_features(cleaned, target, ids, fe["ordinal_cardinality_threshold"],
                                 fe["drop_low_variance"])
        res.feature_model = fm
        feats = fm.feature_columns
        if fe["feature_selection"] and len(feats) > fe["top_k_features"]:
            enc = fm.encode(cleaned)
            means = {c: fm.scaler[c][0] for c in feats if c in fm.scaler}
            res.mi_scores = select.feature_scores(
                enc, feats, target, res.task_type == "classification", fe["mi_estimator"], fill=means).persist()
            held.append(res.mi_scores)
            top = select.select_top_features(res.mi_scores, fe["top_k_features"]).collect()
            feats = [r["feature"] for r in sorted(top, key=lambda r: r["rk"])]
        res.selected_features = feats
        state["features"] = fm.transform(cleaned).select(KEY, *[F.col(q(c)) for c in feats], F.col(q(target)))
        sink(state["features"].drop(KEY), "features")
        if output_root:
            fm.save(spark, res.path("transformer"))

    def do_train():
        data = state["features"]
        feats = res.selected_features
        if res.task_type == "classification":
            labels = encode.fit_labels(data, target)
            data = encode.label_encode(data, target, labels, out="_label")
            n_classes = labels.count()
        else:
            data = data.withColumn("_label", F.col(q(target)).cast("double"))
            n_classes = 0
        data = data.withColumn("_label", F.col("_label").cast("double")).where(
            F.col("_label").isNotNull())
        data = cut_lineage(data.select(KEY, *[F.col(q(c)).cast("double").alias(c) for c in feats], "_label"))
        train, test = split.train_test_split(data, KEY)
        names = cfg["training"]["models"] or profile.DEFAULT_MODELS[res.task_type]
        res.trained, res.model_errors = models.train_all(
            names, train, test, feats, "_label", res.task_type, n_classes,
            cfg["training"]["forest_depth"], limit_seconds=cfg["training"]["limit_seconds"])
        res.metrics = models.metrics_table(res.trained)
        if output_root:
            for t in res.trained:
                res.artifacts[t.name] = models.save_model(t, f"{res.path('models')}/{t.name}")

    def do_evaluate():
        res.leaderboard = rank.model_comparison(res.metrics, res.task_type).orderBy("rk")
        res.summary = rank.evaluation_summary(res.metrics, res.task_type)
        paths = spark.createDataFrame(list(res.artifacts.items()), "model STRING, path STRING")
        res.best_artifact = rank.best_artifact(res.leaderboard, paths)
        sink(res.leaderboard, "leaderboard")

    def do_report():
        res.report = run_report(spark, res)
        sink(res.report, "report")

    try:
        res.record(runlog.RUNNING)
        if stage("planner", do_plan):
            stage("eda", do_eda)
            stage("cleaning", do_clean)
            if "clean" in state:
                stage("feature_engineering", do_features)
            if "features" in state:
                stage("training", do_train)
            if res.metrics is not None:
                stage("evaluation", do_evaluate)
            stage("report", do_report)
    finally:
        for table in held:
            if table is not None:
                table.unpersist()
    res.record(runlog.FAILED if res.errors else runlog.COMPLETED, "; ".join(res.errors) or None)
    if output_root:
        res.run_events(spark).write.mode("append").parquet(f"{output_root.rstrip('/')}/run_events")
        res.timeline(spark).write.mode("append").parquet(f"{output_root.rstrip('/')}/run_stages")
    return res


def run_report(spark, res: ExperimentResult) -> DataFrame:
    """All ten sections from what the run has; a stage that failed leaves its section with its error only."""
    r, c = report, res.cleaning_report
    fm = res.feature_model
    parts = [r.facts(spark, r.SUMMARY, {"run_id": res.run_id, "task_type": res.task_type, "target": res.target,
                                        "n_errors": len(res.errors), "warnings": "; ".join(res.warnings)})]
    if res.plan is not None:
        parts.append(r.fields(r.OVERVIEW, res.plan, ["n_rows", "n_cols", "n_features", "n_numeric",
                                                     "n_categorical", "has_missing"]))
    for name in ("class_balance", "target_summary"):
        if name in res.eda:
            t = res.eda[name]
            parts.append(r.section(r.OVERVIEW, t, F.concat(F.lit("class:"), F.col("class")), F.col("n"))
                         if name == "class_balance" else r.fields(r.OVERVIEW, t, t.columns))
    if "missing" in res.eda:
        parts.append(r.section(r.QUALITY, res.eda["missing"], F.col("column"), F.format_string("%.2f", "pct")))
    if c:
        parts.append(r.facts(spark, r.CLEANING, {k: ", ".join(v) if isinstance(v, list) else v for k, v in c.items()
                                                 if not isinstance(v, dict)}))
        parts.append(r.facts(spark, r.CLEANING, {f"clip:{k}": v for k, v in c["clip_bounds"].items()} or
                             {"clip": "none"}))
    if fm is not None:
        parts.append(r.facts(spark, r.FEATURES, {
            "features_before": len(fm.features_before), "features_after": len(fm.feature_columns),
            "selected": ", ".join(res.selected_features), "ordinal": ", ".join(fm.ordinal),
            "one_hot": ", ".join(fm.one_hot), "low_variance": ", ".join(fm.low_variance)}))
        if res.mi_scores is not None:
            parts.append(r.section(r.FEATURES, res.mi_scores, F.concat(F.lit("mi:"), F.col("feature")), F.col("mi")))
    if res.metrics is not None:
        parts.append(r.section(r.TRAINING, res.metrics, F.concat_ws(":", "model", "metric"), F.col("value")))
    if res.leaderboard is not None:
        parts.append(r.section(r.LEADERBOARD, res.leaderboard, F.format_string("%03d:%s", "rk", "model"),
                               F.col("primary_score")))
        parts.append(r.fields(r.BEST, res.best_artifact, ["model", "primary_score", "path"]))
    parts.append(r.section(r.TIMELINE, res.timeline(spark), F.format_string("%02d:%s", "seq", "stage"),
                           F.concat_ws(" ", "status", F.col("duration_seconds").cast("string"), "error")))
    parts.append(r.facts(spark, r.APPENDIX, {
        **{f"table:{n}": res.path(f"{LAYOUT['eda']}/{n}") if res.root else "not written" for n in res.eda},
        **{f"model:{n}": p for n, p in res.artifacts.items()},
        **{f"model_error:{n}": e for n, e in res.model_errors.items()}, "created": utc_now().isoformat()}))
    return report.report_sections(parts)
