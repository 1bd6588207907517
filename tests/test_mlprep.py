import math

import pytest

from txrisk.operators import mlprep as MP


def test_split_quota(spark):
    rows = [(f"id{i}", 0) for i in range(9814)] + [(f"a{i}", 1) for i in range(186)]
    df = spark.createDataFrame(rows, "transaction_id string, is_anomaly int")
    out = MP.stratified_split(df)
    counts = {(r.split, r.is_anomaly): r["count"] for r in out.groupBy("split", "is_anomaly").count().collect()}
    assert counts[("test", 0)] == 1963 and counts[("test", 1)] == 37
    assert counts[("train", 0)] == 7851 and counts[("train", 1)] == 149
    # deterministic membership
    a = out.where("split = 'test'").select("transaction_id")
    b = MP.stratified_split(df).where("split = 'test'").select("transaction_id")
    assert a.exceptAll(b).count() == 0


def test_population_scaler(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    st = MP.fit_scaler(df, ["x"]).collect()[0]
    assert st.scale_x == pytest.approx(1.247219, abs=1e-6)
    const = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    z = MP.standard_scale(const, MP.fit_scaler(const, ["x"]), ["x"]).collect()
    assert [r.x for r in z] == [0.0, 0.0]


def test_one_hot_unseen(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",)], "c string")
    levels = MP.category_levels(train, ["c"])
    score = spark.createDataFrame([("a",), ("zz",)], "c string")
    out = MP.one_hot_encode(score, levels, keep=[]).collect()
    assert [tuple(r) for r in out] == [(1, 0), (0, 0)]


def test_feature_pipeline_population_scale_and_unseen(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (4.0, "b")], "x double, c string")
    model = MP.feature_pipeline(train, numeric=["x"], categorical=["c"])
    score = spark.createDataFrame([(4.0, "zz")], "x double, c string")
    v = MP.apply_pipeline(model, score, categorical=["c"]).collect()[0].features.toArray().tolist()
    mean, sd = 7 / 3, math.sqrt(((1 - 7 / 3) ** 2 + (2 - 7 / 3) ** 2 + (4 - 7 / 3) ** 2) / 3)
    assert v[0] == pytest.approx((4.0 - mean) / sd)
    assert v[1:] == [0.0, 0.0]


def test_split_keeps_unlabelled_rows_in_train(spark):
    rows = [(f"id{i}", 0) for i in range(80)] + [(f"a{i}", 1) for i in range(20)] + [("u1", None), ("u2", None)]
    df = spark.createDataFrame(rows, "transaction_id string, is_anomaly int")
    out = {r.transaction_id: r.split for r in MP.stratified_split(df).collect()}
    assert len(out) == 102 and out["u1"] == out["u2"] == "train"
    assert sum(1 for k, v in out.items() if v == "test") == 20


def test_split_quotas_with_unlabelled_and_three_classes(spark):
    rows = ([(f"a{i}", 0) for i in range(33)] + [(f"b{i}", 1) for i in range(33)] + [(f"c{i}", 2) for i in range(34)]
            + [(f"u{i}", None) for i in range(7)])
    df = spark.createDataFrame(rows, "transaction_id string, is_anomaly int")
    got = {}
    for r in MP.stratified_split(df).where("split = 'test'").groupBy("is_anomaly").count().collect():
        got[r.is_anomaly] = r["count"]
    # N = 100 labelled -> 20 test; train quotas by largest remainder: 26.4, 26.4, 27.2 -> 27, 26, 27
    assert sum(got.values()) == 20 and None not in got
    assert got == {0: 6, 1: 7, 2: 7}
