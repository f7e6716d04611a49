import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixtures import greenhouse_beds, ferry_crossings, to_spark
from tabloom.operators import encode, select


def test_constant_column_removed(spark):
    pdf = greenhouse_beds(100)
    pdf["constant"] = 5.0
    fm = encode.fit_features(to_spark(spark, pdf), "pests")
    assert fm.low_variance == ["constant"]
    assert "constant" not in fm.feature_columns


def test_threshold_zero_one_hots_everything(spark):
    fm = encode.fit_features(to_spark(spark, greenhouse_beds()), "pests", ordinal_threshold=0)
    assert fm.ordinal == {} and list(fm.one_hot) == ["house"]
    # three categories, the first in sorted order dropped
    assert fm.one_hot["house"] == ["dome", "tunnel"]


def test_ordinal_codes_sorted_and_unseen_minus_one(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "c STRING")
    codes = encode.fit_ordinal(df, ["c"])
    assert codes == {"c": {"a": 0.0, "b": 1.0, "c": 2.0, "nan": 3.0}}
    new = spark.createDataFrame([("z",), ("b",)], "c STRING")
    assert [r["c"] for r in encode.apply_ordinal(new, codes).collect()] == [-1.0, 1.0]


def test_high_cardinality_capped_at_50(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"num": rng.uniform(0, 1, 300),
                        "high_card": [f"v{i % 100:03d}" for i in range(300)],
                        "target": rng.integers(0, 2, 300)})
    fm = encode.fit_features(to_spark(spark, pdf), "target")
    levels = fm.one_hot["high_card"]
    assert len(levels) == 50          # 50 kept + __other__, first level dropped
    assert "__other__" not in levels  # "__other__" sorts first and is the dropped level


def test_scaler_population_std_and_zero_std(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (3.0, 3.0)], "a DOUBLE, b DOUBLE")
    out = encode.standard_scale(df, ["a", "b"]).collect()
    s = np.std([1, 2, 3])
    assert [r["a"] for r in out] == pytest.approx([-1 / s, 0, 1 / s])
    assert [r["b"] for r in out] == [0.0, 0.0, 0.0]


def test_top_k_selection(spark):
    rng = np.random.default_rng(99)
    pdf = pd.DataFrame(rng.uniform(0, 1, (200, 30)), columns=[f"f{i}" for i in range(30)])
    pdf["target"] = (pdf["f3"] + 0.1 * rng.normal(size=200) > 0.5).astype(int)
    df = to_spark(spark, pdf)
    scores = select.mutual_information(df, [f"f{i}" for i in range(30)], "target", True)
    top = select.select_top_features(scores, 10).collect()
    assert len(top) == 10
    assert sorted(top, key=lambda r: r["rk"])[0]["feature"] == "f3"


def test_mutual_information_matches_numpy(spark):
    pdf = ferry_crossings()
    df = to_spark(spark, pdf)
    got = {r["feature"]: r["mi"] for r in
           select.mutual_information(df, ["km", "wind"], "minutes", False).collect()}

    def binned(x):
        lo, hi = x.min(), x.max()
        return np.minimum(np.floor((x - lo) / (hi - lo) * 32), 31)

    for f in ("km", "wind"):
        joint = pd.crosstab(binned(pdf[f]), binned(pdf["minutes"])).values / len(pdf)
        px, py = joint.sum(1, keepdims=True), joint.sum(0, keepdims=True)
        nz = joint > 0
        mi = (joint[nz] * np.log(joint[nz] / (px @ py)[nz])).sum()
        assert got[f] == pytest.approx(round(mi, 6), abs=1e-6)


def test_label_encode_sorted(spark):
    df = spark.createDataFrame([("yes",), ("no",), ("maybe",)], "t STRING")
    out = {r["t"]: r["code"] for r in encode.label_encode(df, "t", out="code").collect()}
    assert out == {"maybe": 0, "no": 1, "yes": 2}


def test_features_as_double_booleans(spark):
    df = spark.createDataFrame([(True, 1), (False, 2)], "b BOOLEAN, i INT")
    rows = encode.features_as_double(df, ["b", "i"]).collect()
    assert [(r["b"], r["i"]) for r in rows] == [(1.0, 1.0), (0.0, 2.0)]
