"""Model operators: quality thresholds on seeded data, scoring invariants, stores."""
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from txrisk.operators import evaluation as EV
from txrisk.operators import features as FE
from txrisk.operators import mlprep as MP
from txrisk.operators import models as MD
from txrisk.plans import queries_ml as QM
from txrisk.session import scratch_path
from txrisk.sources import adapter as A
from txrisk.sources import io as IO

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def encoded(spark):
    enc, pipe = QM.encoded(spark, SF)
    return enc.cache(), pipe


def _eval(model, enc):
    test = MD.score(model, enc.where(F.col("split") == "test").select("transaction_id", "features", "is_anomaly"))
    m = EV.classification_metrics(test, label_col="is_anomaly").collect()[0]
    auc = EV.roc_auc(test, label_col="is_anomaly").collect()[0].roc_auc
    return m, auc


def test_logistic_quality(spark, encoded):
    enc, _ = encoded
    m, auc = _eval(MD.train_logistic(enc.where(F.col("split") == "train")), enc)
    assert auc > 0.95 and m.f1 > 0.6


def test_forest_quality_and_drivers(spark, encoded):
    enc, _ = encoded
    model = MD.train_forest(enc.where(F.col("split") == "train"), num_trees=20, max_depth=8)
    m, auc = _eval(model, enc)
    assert auc > 0.97 and m.f1 > 0.75
    names = MP.pipeline_feature_names(encoded[1])
    assert len(names) == enc.select(F.size(vector_to_array("features"))).first()[0]
    assert names[:6] == MP.ENGINEERED_NUMERIC and "is_international_1" in names
    drivers = MD.feature_drivers(spark, model, names).collect()
    assert len(drivers) == 10 and drivers[0].feature == "amount"


def test_random_search_candidates_and_ranks(spark, encoded):
    cands = MD.sample_candidates()
    assert len(cands) == 15 and len({str(c) for c in cands}) == 15
    assert MD.sample_candidates() == cands            # seeded
    enc, _ = encoded
    train = MD.stratified_folds(enc.where(F.col("split") == "train").select("transaction_id", "features",
                                                                          "is_anomaly"), k=3)
    folds = {r.fold: r["count"] for r in train.groupBy("fold").count().collect()}
    assert set(folds) == {0, 1, 2} and max(folds.values()) - min(folds.values()) <= 2
    small = [{"numTrees": 5, "maxDepth": 3}, {"numTrees": 5, "maxDepth": 5}]
    found, _ = MD.tune_forest(train, small, num_folds=3)
    res = MD.cv_results(spark, found).collect()
    assert sorted(r.rank_test_score for r in res)[0] == 1 and len(res) == 2
    for r in res:   # per-fold scores reproduce the search's mean
        assert len(r.split_test_scores) == 3
        assert sum(r.split_test_scores) / 3 == pytest.approx(r.mean_test_score)


def test_score_batch_keeps_rows_and_order(spark, encoded):
    enc, pipe = encoded
    model = MD.train_logistic(enc.where(F.col("split") == "train"))
    t = A.transactions(spark, SF)
    sp = enc.select("transaction_id", "split")
    tagged = t.join(sp, "transaction_id")
    batch = tagged.where(F.col("split") == "test").drop("split")
    history = tagged.where(F.col("split") == "train").drop("split")
    out = MD.score_batch(batch, pipe, model, history=history, ts_col="ts", order_col="transaction_id")
    rows = out.collect()
    assert len(rows) == batch.count()
    ids = [r.transaction_id for r in rows]
    assert ids == sorted(ids)
    assert all(r.probability_score == round(r.probability_score, 4) for r in rows)
    # input columns come back as given (locations keep their case), plus the four outputs
    assert out.columns == batch.columns + ["prediction", "probability_score", "risk_score", "risk_level"]
    given = {r.transaction_id: r.location for r in batch.collect()}
    assert all(given[r.transaction_id] == r.location for r in rows)
    counts = out.groupBy("risk_level").count().collect()
    assert sum(r["count"] for r in counts) == len(rows)


def test_score_batch_returns_invalid_rows_without_a_score(spark, encoded):
    """One bad row must not cost the batch: every row comes back, the bad ones unscored and no context of others."""
    from txrisk.operators import quality as QA
    enc, pipe = encoded
    model = MD.train_logistic(enc.where(F.col("split") == "train"), max_iter=5)
    good = A.transactions(spark, "/root/testdata/sf0.001").limit(200).cache()
    first = good.limit(1)
    bad = first.withColumn("amount", F.lit(0.0)).withColumn("transaction_id", F.lit("ZERO")).unionByName(
        first.withColumn("customer_id", F.lit(None).cast("string")).withColumn("transaction_id", F.lit("NOBODY"))).unionByName(
        first.withColumn("amount", F.lit(None).cast("double")).withColumn("transaction_id", F.lit("EMPTY")))
    batch = good.unionByName(bad)
    with pytest.raises(QA.ValidationError):
        MD.score_batch(batch, pipe, model, ts_col="ts")
    out = MD.score_batch(batch, pipe, model, ts_col="ts", keep_invalid=True)
    assert out.columns == batch.columns + ["prediction", "probability_score", "risk_score", "risk_level"]
    unscored = out.where(F.col("prediction").isNull())
    assert {r.transaction_id for r in unscored.collect()} == {"ZERO", "NOBODY", "EMPTY"}
    assert unscored.where(F.coalesce("probability_score", "risk_score", F.col("risk_level").isNotNull().cast("int")) > 0).isEmpty()
    alone = MD.score_batch(good, pipe, model, ts_col="ts")
    assert out.where(F.col("prediction").isNotNull()).exceptAll(alone).isEmpty() and out.count() == 203


def test_model_store_round_trip(spark, encoded):
    enc, pipe = encoded
    model = MD.train_logistic(enc.where(F.col("split") == "train"))
    path = scratch_path(spark, "test-model-store")
    MD.save_model(pipe, path + "/pipe")
    MD.save_model(model, path + "/lr")
    from pyspark.ml.classification import LogisticRegressionModel
    again = LogisticRegressionModel.load(path + "/lr")
    test = enc.where(F.col("split") == "test").select("transaction_id", "features", "is_anomaly")
    a = MD.score(model, test).select("transaction_id", "probability")
    b = MD.score(again, test).select("transaction_id", "probability")
    assert a.exceptAll(b).count() == 0
    assert MD.load_pipeline(path + "/pipe") is not None


def test_features_invariant_to_input_order(spark):
    t = A.transactions(spark, "/root/testdata/sf0.001")
    a = FE.engineer_features(t, ts_col="ts")
    b = FE.engineer_features(t.repartition(7, "amount").orderBy(F.rand(5)), ts_col="ts")
    cols = ["transaction_id", "customer_txn_count_30d", "customer_avg_amount_30d", "amount_ratio_to_avg"]
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0


def test_scan_missing_path_raises(spark):
    with pytest.raises(Exception):
        IO.scan_transactions(spark, scratch_path(spark, "does-not-exist.csv")).collect()


def test_empty_file_is_empty_input(spark, tmp_path):
    from txrisk.operators import quality as QA
    p = tmp_path / "empty.csv"
    p.write_text("\n")
    with pytest.raises(Exception):
        QA.validate_transactions(IO.scan_transactions(spark, str(p)))


def test_policy_defaults_per_key_and_bad_file(spark, tmp_path):
    p = tmp_path / "policy.json"
    p.write_text('{"low_risk_threshold": 0.3}')
    r = IO.risk_policy(spark, str(p)).collect()[0]
    assert (r.low_risk_threshold, r.high_risk_threshold) == (0.3, 0.6)
    bad = tmp_path / "bad.json"
    bad.write_text("not json at all")
    r = IO.risk_policy(spark, str(bad)).collect()[0]
    assert (r.low_risk_threshold, r.high_risk_threshold) == (0.2, 0.6)
    r = IO.risk_policy(spark, str(tmp_path / "absent.json")).collect()[0]
    assert (r.low_risk_threshold, r.high_risk_threshold) == (0.2, 0.6)


def test_metric_store_lookup_and_fallback(spark, tmp_path):
    path = str(tmp_path / "metrics")
    rows = [("baseline", "f1_score", 0.9), ("random_forest", "f1_score", 0.95),
            ("random_forest_tuned", "f1_score", 0.97)]
    IO.save_metrics(spark.createDataFrame(rows, "model string, metric string, value double"), path, mode="overwrite")
    pick = lambda name: {r.model for r in IO.load_model_metrics(spark, path, name).collect()}
    assert pick("random_forest") == {"random_forest"}                 # exact name
    assert pick("models/random_forest_tuned.joblib") == {"random_forest_tuned"}   # longest contained name
    assert pick("Models/Random_Forest_TUNED.pkl") == {"random_forest_tuned"}      # in any case
    assert pick("RF_2024") == {"random_forest"}
    assert pick("something_else") == {"baseline"}                     # a name that speaks of no forest
    only = str(tmp_path / "only")
    IO.save_metrics(spark.createDataFrame(rows[1:], "model string, metric string, value double"), only)
    assert {r.model for r in IO.load_model_metrics(spark, only, "something_else").collect()} == {"random_forest_tuned"}


def test_metric_store_keeps_runs_apart(spark, tmp_path):
    path = str(tmp_path / "metrics")
    frame = lambda rows: spark.createDataFrame(rows, "model string, metric string, value double")
    old = frame([("baseline", "f1_score", 0.1), ("random_forest", "f1_score", 0.2)])
    old.write.parquet(path)                                           # stored before runs had names
    IO.save_metrics(frame([("baseline", "f1_score", 0.5), ("baseline", "recall", 0.4)]), path)
    IO.save_metrics(frame([("baseline", "f1_score", 0.7)]), path)
    now = {(r.model, r.metric, r.value) for r in IO.current_metrics(spark, path).collect()}
    assert now == {("baseline", "f1_score", 0.7), ("random_forest", "f1_score", 0.2)}
    assert [tuple(r) for r in IO.load_model_metrics(spark, path, "baseline").collect()] == [("baseline", "f1_score", 0.7)]


def test_csv_sink_round_trip(spark, tmp_path):
    t = A.transactions(spark, "/root/testdata/sf0.001").select("transaction_id", "amount", "merchant_category")
    out = IO.write_table(t, str(tmp_path / "t_csv"), fmt="csv", partition_by=["merchant_category"])
    back = IO.scan_transactions(spark, out)
    assert back.count() == t.count()
    assert set(back.columns) == {"transaction_id", "amount", "merchant_category"}
