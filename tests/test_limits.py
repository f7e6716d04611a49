"""A limit on the time of a model, and the size of a registered file."""

import os
import tempfile
import time

from tabloom.operators import models, runlog


class Endless:
    def fit_columns(self, train, features, label):
        def wait(batches):
            for b in batches:
                time.sleep(1)
                yield b
        for _ in range(600):
            train.sparkSession.range(1).mapInArrow(wait, "id long").collect()


def test_an_endless_fit_is_stopped_and_the_others_go_on(spark, monkeypatch):
    monkeypatch.setitem(models.REGISTRY, "endless", {"classification": lambda *_: Endless(), "regression": None})
    df = spark.createDataFrame([(float(k % 7), float(k % 2)) for k in range(60)], "a double, y double")
    began = time.time()
    done, errors = models.train_all(["endless", "logistic_regression"], df, df, ["a"], "y", "classification", 2, limit_seconds=25)
    assert [t.name for t in done] == ["logistic_regression"] and errors == {"endless": "stopped after 25 s"}
    assert time.time() - began < 120
    assert spark.range(5).count() == 5          # later jobs carry no tag


def test_registration_with_file_size(spark):
    folder = tempfile.mkdtemp(prefix="tabloom-r-")
    path = os.path.join(folder, "my.table.CSV")
    with open(path, "w") as f:
        f.write("a,b\n1,x\n2,y\n")
    df = spark.read.option("header", True).csv(path)
    row = runlog.registration_row(df, source=path).first()
    assert (row.name, row.n_rows, row.n_cols, row.n_bytes, row.file_path) == ("my.table", 2, 2, 12, path)
    assert runlog.registration_row(df, "other", path).first().name == "other"
    assert "n_bytes" not in runlog.registration_row(df, "t").columns
