"""The stored run log against the state computed from all events."""

import uuid

import pytest
from pyspark.sql import functions as F

from tabloom.operators import runlog
from tabloom.operators.runstore import RunStore, _merge, _summary
from tabloom.sources.tables import run_events
from conftest import SF0001


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def name():
    return "log" + uuid.uuid4().hex[:8]


def test_appends_in_any_order_equal_one_aggregate(spark, tmp_path, name):
    ev = run_events(spark, SF0001)
    store = RunStore(spark, name, str(tmp_path / "a'b"), 4)
    for part in (1, 0, 2):
        assert store.append(ev.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == part)) == store.version()
    want = runlog.run_latest_state(ev)
    assert store.latest().columns == want.columns and rows(store.latest()) == rows(want)
    assert rows(store.events().drop("batch")) == rows(ev)


def test_reads_and_joins_by_run_without_exchange(spark, tmp_path, name):
    store = RunStore(spark, name, str(tmp_path), 4)
    store.append(run_events(spark, SF0001))
    latest, other = store.latest(), store.latest().select("run_id", F.col("status").alias("was"))
    joined = latest.join(other.hint("merge"), "run_id").groupBy("run_id").agg(F.max("was").alias("was"))
    for df in (latest, joined):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == latest.count()
    more = run_events(spark, SF0001).where("run_id % 2 = 0")
    plan = _merge(store._state(1), store._dealt(_summary(more)))._jdf.queryExecution().executedPlan().toString()
    old = plan[:plan.index("state_1")]
    assert "Bucketed: true" in plan and "Exchange" not in old      # the new side only is shuffled


def test_a_failed_append_is_not_seen_and_can_be_repeated(spark, tmp_path, name):
    ev = run_events(spark, SF0001)
    store = RunStore(spark, name, str(tmp_path), 4)
    with pytest.raises(ValueError):
        store.latest()
    store.append(ev.where("seq % 2 = 0"))
    before = rows(store.latest())
    ev.limit(7).write.parquet(f"{tmp_path}/events/batch=2")       # what a lost writer leaves
    assert rows(store.latest()) == before and store.events().where("batch = 2").count() == 0
    store.append(ev.where("seq % 2 = 1"))
    assert rows(store.latest()) == rows(runlog.run_latest_state(ev))


def test_another_session_and_odd_events(spark, tmp_path, name):
    cols = "run_id bigint, seq bigint, ts timestamp, status string, dataset_id int, message string"
    ev = spark.createDataFrame([(None, 1, None, "pending", 1, None), (5, 3, None, None, None, ""), (5, 3, None, None, None, "")], cols)
    store = RunStore(spark, name, str(tmp_path), 3)
    store.append(ev.limit(0))
    assert store.latest().count() == 0
    store.append(ev)
    spark.sql(f"DROP TABLE {store._table(2)}")          # external: the files stay
    again = RunStore(spark, name, str(tmp_path), 3).latest()
    assert [(r.run_id, r.status, r.error_message, r.n_events) for r in again.collect()] == [(5, None, "", 2)]
    assert store.events().count() == 3
