import pytest
from pyspark.sql import functions as F

from txrisk.operators import evaluation as EV
from txrisk.operators import risk as RK


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "label int, probability double")
    assert EV.roc_auc(df).collect()[0].roc_auc == pytest.approx(0.625)
    pts = EV.roc_curve(df, drop_intermediate=False).orderBy("point").collect()
    assert (pts[0].fpr, pts[0].tpr) == (0.0, 0.0) and (pts[-1].fpr, pts[-1].tpr) == (1.0, 1.0)


def _golden(spark):
    rows = [(0, 0)] * 1962 + [(0, 1)] * 1 + [(1, 1)] * 37
    return spark.createDataFrame(rows, "label int, prediction int")


def test_confusion_golden(spark):
    m = EV.classification_metrics(_golden(spark)).collect()[0]
    assert (m.tn, m.fp, m.fn, m.tp) == (1962, 1, 0, 37)
    assert m.accuracy == pytest.approx(0.9995)
    assert m.precision == pytest.approx(0.973684, abs=1e-6)
    assert m.recall == 1.0 and m.f1 == pytest.approx(0.986667, abs=1e-6)
    rep = {r.class_label: r for r in EV.classification_report(_golden(spark)).collect()}
    assert rep["macro avg"].f1 == pytest.approx(0.993206, abs=1e-6)
    cm = {(r.actual, r.predicted): r["count"] for r in EV.confusion_matrix(_golden(spark)).collect()}
    assert cm == {(0, 0): 1962, (0, 1): 1, (1, 0): 0, (1, 1): 37}


def test_tiers_golden(spark):
    rows = [(0.01,)] * 1962 + [(0.95,)] * 38
    df = RK.risk_level(spark.createDataFrame(rows, "probability double"))
    s = RK.risk_summary(df).collect()[0]
    assert (s.low_risk_cases, s.medium_risk_cases, s.high_risk_cases) == (1962, 0, 38)
    assert (s.percentage_low_risk, s.percentage_medium_risk, s.percentage_high_risk) == (98.1, 0.0, 1.9)
    counts = RK.risk_level_counts(df).orderBy("tier_order").collect()
    assert [(r.risk_level, r["count"]) for r in counts] == [("Low Risk", 1962), ("Medium Risk", 0), ("High Risk", 38)]


def test_tier_edges(spark):
    df = spark.createDataFrame([(0.19999,), (0.2,), (0.59999,), (0.6,)], "probability double")
    got = [r.risk_level for r in RK.risk_level(df).collect()]
    assert got == ["Low Risk", "Medium Risk", "Medium Risk", "High Risk"]


def test_average_precision_step_sum(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "label int, probability double")
    # thresholds 0.9: P=1, R=.5 ; 0.8: P=.5 ; 0.7: P=2/3, R=1  -> AP = .5*1 + .5*(2/3)
    assert EV.average_precision(df).collect()[0].average_precision == pytest.approx(0.5 + 1 / 3)


def test_recommendations_rules(spark):
    kpi = spark.createDataFrame([(100, 6, 45.0, 0.5)],
                                "total_transactions long, high_risk long, mean_risk_score double, "
                                "mean_anomaly_confidence double")
    recs = RK.recommendations(kpi).orderBy("rec_no").collect()
    assert [r.level for r in recs] == ["High Priority", "Medium Priority", "Medium Priority"]
    kpi0 = spark.createDataFrame([(100, 1, 10.0, 0.0)], kpi.schema)
    assert [r.rec_no for r in RK.recommendations(kpi0).collect()] == [1, 2]


def test_run_level_metrics_needs_two_classes(spark):
    one = spark.createDataFrame([(0, 0), (0, 1)], "is_anomaly int, prediction int")
    assert EV.run_level_metrics(one).count() == 0
    two = spark.createDataFrame([(0, 0), (1, 1)], "is_anomaly int, prediction int")
    assert EV.run_level_metrics(two).collect()[0].f1 == 1.0


def test_churn_score(spark):
    df = spark.createDataFrame([(10.0, 0), (100.0, 1), (50.0, 10)], "monthly_charges double, tenure int")
    out = RK.churn_score(df).collect()
    assert [(r.churn_prediction, r.risk_score) for r in out] == [(True, 99.0), (True, 99.0), (False, 50.0)]


def _roc_bruteforce(labels, scores, drop=True):
    import numpy as np
    order = np.argsort(-scores, kind="mergesort")
    s, y = scores[order], labels[order]
    distinct = np.r_[np.where(np.diff(s))[0], y.size - 1]
    tps = np.cumsum(y)[distinct]
    fps = (1 + distinct) - tps
    thr = s[distinct]
    if drop and len(fps) > 2:
        keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
        fps, tps, thr = fps[keep], tps[keep], thr[keep]
    fpr = np.r_[0, fps] / max(fps[-1], 1)
    tpr = np.r_[0, tps] / max(tps[-1], 1)
    return fpr, tpr


def test_roc_curve_dense_scores_match_bruteforce(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    n = 6000
    y = rng.integers(0, 2, n)
    # many distinct scores per bucket, plus tie runs and collinear stretches
    s = np.round(np.clip(rng.normal(0.5 + 0.1 * y, 0.05), 0, 1), 5)
    s[:500] = 0.5
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, probability double")
    got = EV.roc_curve(df).orderBy("point").collect()
    fpr, tpr = _roc_bruteforce(y, s)
    assert [r.point for r in got] == list(range(len(fpr)))
    assert np.allclose([r.fpr for r in got], fpr) and np.allclose([r.tpr for r in got], tpr)
    auc = EV.roc_auc(df).collect()[0].roc_auc
    assert auc == pytest.approx(float(np.trapezoid(_roc_bruteforce(y, s, drop=False)[1],
                                                   _roc_bruteforce(y, s, drop=False)[0])))


def test_score_histogram_by_group(spark):
    rows = [("a", 1.0), ("a", 99.0), ("b", 50.0)]
    df = spark.createDataFrame(rows, "model string, risk_score double")
    h = RK.risk_score_histogram(df, bins=4, by=["model"]).collect()
    assert len(h) == 8
    assert sum(r["count"] for r in h if r.model == "a") == 2 and sum(r["count"] for r in h if r.model == "b") == 1


def test_release_shared_unpersists_library_intermediates(spark):
    from txrisk.session import release_shared
    release_shared()
    df = spark.createDataFrame([(1, 0.9), (0, 0.2)], "label int, probability double")
    EV.roc_auc(df).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() >= 1
    assert release_shared() >= 1
    assert release_shared() == 0


def test_bottom_heavy_scores_are_split_evenly(spark):
    """Nearly all scores of a rare-event model lie close to zero; buckets follow ranks, so none is hot."""
    n = 6000
    df = spark.range(n).select(F.when(F.col("id") % 41 == 0, 1).otherwise(0).alias("label"),
                               (F.pow(F.rand(3), 12) + F.when(F.col("id") % 41 == 0, 0.01).otherwise(0.0)).alias("probability"),
                               (F.col("id") % 2).alias("model"))
    df = spark.createDataFrame(df.collect(), df.schema)
    sc = EV.score_counts(df, by=["model"], buckets=16, keep_bucket=True)
    sizes = [r["count"] for r in sc.groupBy("_b").count().collect()]
    assert max(sizes) < 4 * n / 16
    rows = df.collect()
    for m in (0, 1):
        pos = [r.probability for r in rows if r.model == m and r.label == 1]
        neg = [r.probability for r in rows if r.model == m and r.label == 0]
        want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
        got = EV.roc_auc(df, by=["model"]).where(F.col("model") == m).first().roc_auc
        assert abs(got - want) < 1e-12
