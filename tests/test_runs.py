"""End-to-end: training run writes models and metrics; prediction run scores a CSV file."""
from pyspark.sql import functions as F

from txrisk.plans.runs import prediction_run, training_run
from txrisk.sources import adapter as A


def test_training_then_prediction(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    raw = A.raw_transactions(spark, sf).withColumnRenamed("ts", "timestamp")
    raw = raw.where(F.col("timestamp") != "not a time")   # strict cleaning rejects unparseable times
    out = str(tmp_path / "train")
    cmp = training_run(spark, raw, out, num_trees=10,
                       candidates=[{"numTrees": 5, "maxDepth": 4}, {"numTrees": 5, "maxDepth": 6}], folds=3)
    rows = {r.model: r for r in cmp.collect()}
    assert set(rows) == {"baseline", "random_forest", "random_forest_tuned"}
    assert sum(r.selected for r in rows.values()) == 1
    assert all(r.roc_auc > 0.9 for r in rows.values())
    # new batch: the clean sf0.001 transactions written as an all-text CSV file
    batch = A.transactions(spark, "/root/testdata/sf0.001").withColumnRenamed("ts", "timestamp")
    src = str(tmp_path / "batch.csv")
    batch.select(*[F.col(c).cast("string") for c in batch.columns]).coalesce(1) \
        .write.option("header", True).csv(src)
    summary = prediction_run(spark, src, out, str(tmp_path / "scored"), model_name="baseline").collect()[0]
    assert summary.processed == batch.count()
    assert summary.high_risk + summary.medium_risk + summary.low_risk == summary.processed
    # in the order of the input, by the selected model unless told otherwise
    prediction_run(spark, src, out, str(tmp_path / "scored_best"))
    ids = lambda path: [r.transaction_id for r in spark.read.option("header", True).csv(path).collect()]
    assert ids(str(tmp_path / "scored_best")) == ids(src)
    assert spark.read.parquet(out + "/risk_summary").count() == 1
    # with a stricter policy file and the clean training history as context
    policy = tmp_path / "policy.json"
    policy.write_text('{"low_risk_threshold": 0.01, "high_risk_threshold": 0.02}')
    hist = str(tmp_path / "history")
    A.transactions(spark, sf).withColumnRenamed("ts", "timestamp").write.parquet(hist)
    strict = prediction_run(spark, src, out, str(tmp_path / "scored2"), model_name="random_forest",
                            history_path=hist, policy_path=str(policy)).collect()[0]
    assert strict.processed == batch.count()
    written = spark.read.option("header", True).csv(str(tmp_path / "scored2"))
    p = F.col("probability_score").cast("double")
    # tiers follow the policy file (probability_score is rounded to 4 dp, so keep a margin)
    assert written.where((p >= 0.0201) & (F.col("risk_level") != "High Risk")).count() == 0
    assert written.where((p < 0.0099) & (F.col("risk_level") != "Low Risk")).count() == 0
