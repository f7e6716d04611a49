"""Named behaviours: ingest corner cases, missing values, exact splits, whole runs."""

import datetime
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import FAST
from fixtures import ferry_crossings, greenhouse_beds, to_spark
from tabloom.operators import chartdata, clean, encode, metrics, profile, runlog, split
from tabloom.plans.experiment import run_experiment
from tabloom.sources import csv_ingest


def csv_folder(text, encoding="utf-8"):
    d = tempfile.mkdtemp(prefix="tabloom-csv-")
    with open(os.path.join(d, "t.csv"), "wb") as f:
        f.write(text.encode(encoding))
    return d


def test_short_row_with_quoted_commas_is_kept(spark):
    got = csv_ingest.ingest_csv(spark, csv_folder('a,b,c\n1,"x,y,z,w"\n2,q,r\n3,u,v,extra\n4,u,v,\n5,"1,2","3"\n'))
    assert sorted(r.a for r in got.table.collect()) == [1, 2, 5]
    assert got.table.where("a = 1").first()["b"] == "x,y,z,w"
    assert got.quarantine.count() == 2
    got.release()


def test_quoted_newline_is_one_record(spark):
    got = csv_ingest.ingest_csv(spark, csv_folder('id,note\n1,"two\nlines"\n2,"say ""hi"""\n3,plain\n'))
    rows = {r.id: r.note for r in got.table.collect()}
    assert rows == {1: "two\nlines", 2: 'say "hi"', 3: "plain"}
    got.release()


def test_number_suffixes_stay_text(spark):
    got = csv_ingest.ingest_csv(spark, csv_folder("seat,x,y\n12D,1e3,1.\n7F,-.5,inf\n3D,+2,\n"))
    assert got.types == {"seat": "string", "x": "double", "y": "double"}
    assert sorted(r.seat for r in got.table.collect()) == ["12D", "3D", "7F"]
    assert sorted(r.x for r in got.table.collect()) == [-0.5, 2.0, 1000.0]
    got.release()


def test_upload_limit_is_opt_in(spark):
    d = csv_folder("a\n1\n")
    assert csv_ingest.ingest_csv(spark, d).table.count() == 1
    with pytest.raises(csv_ingest.IngestError):
        csv_ingest.ingest_csv(spark, d, max_bytes=1)


def test_dataset_name():
    assert csv_ingest.dataset_name("s3://b/x/Sales.2024.CSV") == ("Sales.2024", ".csv")
    assert csv_ingest.dataset_name("/data/orders") == ("orders", "")


def test_nan_is_neither_outlier_nor_clipped(spark):
    rows = [(float(x),) for x in range(20)] + [(float("nan"),)] * 5 + [(None,), (1000.0,)]
    df = spark.createDataFrame(rows, "x DOUBLE")
    assert clean.outlier_count(df, ["x"]).first()["n_outliers"] == 1
    out, report = clean.iqr_clip(df, ["x"])
    assert report.first()["n_clipped"] == 1
    assert out.where(F.isnan("x")).count() == 5 and out.where("x IS NULL").count() == 1
    assert out.where("x > 100 AND NOT isnan(x)").count() == 0


def test_histogram_of_ten_bins(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    assert [r.n for r in chartdata.histogram(df, ["v"], bins=10).orderBy("bin").collect()] == [10] * 10


@pytest.mark.parametrize("keys", [1, 3, 7, 1000])
def test_split_is_exact_with_repeated_keys(spark, keys):
    df = spark.range(1000).select((F.col("id") % keys).alias("k"), (F.col("id") % 50).alias("x"))
    train, test = split.train_test_split(df, "k")
    assert (train.count(), test.count()) == (800, 200)
    both = train.unionByName(test)
    assert both.exceptAll(df).count() == 0 and df.exceptAll(both).count() == 0


def test_run_errors_keep_repeats_in_order(spark):
    rows = [(1, 1, "boom"), (1, 3, "bang"), (1, 2, "boom"), (1, 4, None), (2, 1, None)]
    ev = spark.createDataFrame(rows, "run_id INT, seq INT, message STRING")
    assert [tuple(r) for r in runlog.run_errors(ev).collect()] == [(1, "boom; boom; bang")]


def test_correlation_of_200_columns_expands_no_row(spark):
    x = np.random.default_rng(1).normal(size=(60, 200))
    x[::5, 3] = np.nan
    x[:, 7] = 4.0
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(200)])
    m = profile.correlation_matrix(spark.createDataFrame(pdf), list(pdf.columns))
    assert "Generate" not in m._jdf.queryExecution().executedPlan().toString()
    got = {(r.col_a, r.col_b): r["corr"] for r in m.collect()}
    want = pdf.corr()
    assert len(got) == 40_000 and got[("c7", "c9")] is None
    for a, b in (("c0", "c1"), ("c3", "c150"), ("c199", "c3"), ("c3", "c3")):
        assert got[(a, b)] == pytest.approx(round(want.loc[a, b], 4), abs=1.1e-4)


def test_kde_matches_numpy(spark):
    pdf = ferry_crossings(80)
    got = chartdata.kde_curve(to_spark(spark, pdf), ["km", "wind"]).toPandas()
    for c in ("km", "wind"):
        v = pdf[c].to_numpy()
        bw, spread = v.std(ddof=1) * len(v) ** -0.2, v.max() - v.min()
        grid = np.linspace(v.min() - spread / 2, v.max() + spread / 2, 100)
        want = np.exp(-0.5 * ((grid[:, None] - v) / bw) ** 2).sum(1) / (len(v) * bw * np.sqrt(2 * np.pi))
        mine = got[got.column == c].sort_values("gi")
        assert np.allclose(mine.x, grid) and np.allclose(mine.density, want)


def test_many_labels(spark):
    df = spark.range(150_000).select(F.format_string("c%07d", "id").alias("t"), F.col("id"))
    out = encode.label_encode(df, "t", out="code")
    assert out.where("code <> id").count() == 0 and out.count() == 150_000


def test_auc_over_a_score_array(spark):
    r = np.random.default_rng(2)
    y, p = r.integers(0, 3, 200), r.dirichlet([1, 1, 1, 1], 200)
    rows = [("m", float(a), [float(x) for x in b]) for a, b in zip(y, p)]
    df = spark.createDataFrame(rows, "model STRING, y DOUBLE, p ARRAY<DOUBLE>")
    by_array = metrics.auc_ovr(df, "y", score_array="p").first()["roc_auc"]
    wide = df.select("model", "y", *[F.col("p")[i].alias(f"p{i}") for i in range(4)])
    assert by_array == metrics.auc_ovr(wide, "y", {f"{i}.0": f"p{i}" for i in range(4)}).first()["roc_auc"]


def test_wide_ordinal_is_refused(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        encode.fit_ordinal(df, ["c"])


def test_transformer_round_trip(spark):
    df = to_spark(spark, greenhouse_beds())
    fm = encode.fit_features(df, "pests")
    path = fm.save(spark, os.path.join(tempfile.mkdtemp(prefix="tabloom-fm-"), "t"))
    again = encode.FeatureModel.load(spark, path)
    assert again == fm
    assert fm.transform(df).exceptAll(again.transform(df)).count() == 0


def test_row_key_is_made_before_filling(spark):
    # Rows that differ only in a gap and its fill would be equal afterwards.
    rows = [(float(i % 5), "ab"[i % 2]) for i in range(10)] + [(None, "a"), (None, "b")]
    df = spark.createDataFrame(rows, "x DOUBLE, t STRING")
    out = clean.clean_table(df, "t", key_col="_row_key").table
    assert out.count() == out.select("_row_key").distinct().count() == 12


def run(spark, pdf, target, **kw):
    root = tempfile.mkdtemp(prefix="tabloom-run-")
    return root, run_experiment(to_spark(spark, pdf), target, output_root=root, **kw)


def test_planner_error_stops_the_run(spark):
    root, res = run(spark, greenhouse_beds(), "pests", task_type="clustering")
    assert res.status == "failed" and [s[0] for s in res.stages] == ["planner"]
    assert res.errors and res.cleaning_report == {} and not res.eda
    events = spark.read.parquet(f"{root}/run_events")
    assert [r.status for r in events.orderBy("seq").collect()] == ["pending", "running", "failed"]
    assert runlog.run_transitions_valid(events).first()["valid"]


def test_whole_run_writes_its_tables(spark):
    pdf = greenhouse_beds(160)
    pdf["checked"] = [datetime.date(2024, 1, 1) + datetime.timedelta(days=int(i)) for i in range(160)]
    pdf.loc[::9, "light"] = np.nan
    root, res = run(spark, pdf, "pests", task_type="classification",
                    config={"training": {"models": ["logistic_regression"]}})
    assert res.errors == [] and res.status == "completed"
    assert "checked" in res.selected_features
    at = f"{root}/{res.run_id}"
    assert spark.read.parquet(f"{at}/cleaned").count() == 160
    assert set(spark.read.parquet(f"{at}/features").columns) == {*res.selected_features, "pests"}
    assert encode.FeatureModel.load(spark, f"{at}/transformer") == res.feature_model
    assert {"structure", "correlation", "histogram", "kde", "box", "bars", "class_balance",
            "target_distribution"} <= set(os.listdir(f"{at}/eda"))
    report = spark.read.parquet(f"{at}/report")
    assert sorted(r.section for r in report.select("section").distinct().collect()) == list(range(1, 11))
    best = res.best_artifact.first()
    assert best["model"] == "logistic_regression" and best["path"].startswith(at)
    assert spark.read.parquet(f"{root}/run_stages").where("status = 'success'").count() == 7
    assert runlog.run_transitions_valid(spark.read.parquet(f"{root}/run_events")).first()["valid"]


def test_requested_task_wins_with_a_warning(spark):
    _, res = run(spark, greenhouse_beds(), "pests", task_type="regression",
                 config={"training": {"models": ["linear_regression"]}})
    assert res.errors == [] and res.task_type == "regression" and len(res.warnings) == 1


@pytest.mark.skipif(FAST, reason="model fits are slow")
def test_regressors_beat_the_mean(spark):
    _, res = run(spark, ferry_crossings(200), "minutes", config={"training": {
        "models": ["random_forest", "linear_regression"], "forest_depth": 8}})
    assert res.errors == []
    assert all(r["r2"] > 0.5 for r in res.leaderboard.collect())


def test_forest_keys_fit_at_the_default_depth(monkeypatch):
    import inspect

    from tabloom.operators import models
    from tabloom.plans import queries

    bind, seen = inspect.signature(models.train_model).bind, []

    class Done(Exception):
        pass

    def record(*args, **kw):
        call = bind(*args, **kw)
        call.apply_defaults()
        seen.append(call.arguments["depth"])
        raise Done

    monkeypatch.setattr(queries, "_model_data", lambda *_: (None, None, [], 2))
    monkeypatch.setattr(models, "train_model", record)
    for key in (queries.q_train_rf_classifier, queries.q_train_rf_regressor):
        with pytest.raises(Done):
            key(None, "")
    assert seen == [models.FOREST_DEPTH] * 2
