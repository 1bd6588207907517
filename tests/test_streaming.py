import time
import uuid

from pyspark.sql import functions as F

from txrisk.operators import features as FE
from txrisk.plans.queries_stream import CUTS
from txrisk.session import scratch_path
from txrisk.sources import adapter as A
from txrisk.streaming.scoring import start_scoring_stream, tier_counts_stream


def test_stream_equals_batch_over_three_epochs(spark, sf_small):
    run = scratch_path(spark, f"test-stream-{uuid.uuid4().hex[:8]}")
    src, hist, out, ckpt = (f"{run}/{x}" for x in ("source", "history", "output", "checkpoint"))
    t = A.transactions(spark, sf_small)
    cuts = [F.lit(c).cast("timestamp") for c in CUTS]
    for cond in [F.col("ts") < cuts[0], (F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1]), F.col("ts") >= cuts[1]]:
        t.where(cond).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)          # distinct modification times: the file source orders by them
    q = start_scoring_stream(spark, src, t.schema, hist, out, ckpt, score_fn=lambda d: A.closed_form_score(d),
                             ts_col="ts", max_files_per_trigger=1)
    q.awaitTermination()
    res = spark.read.parquet(out)
    assert res.select("epoch").distinct().count() == 3
    batch = FE.engineer_features(t, ts_col="ts")
    cols = ["transaction_id", "customer_txn_count_30d", "customer_avg_amount_30d"]
    assert res.count() == t.count()
    assert res.select(*cols).exceptAll(batch.select(*cols)).count() == 0


def test_tier_counts_stream_plan(spark, sf_small):
    t = A.closed_form_score(A.transactions(spark, sf_small)).withColumn("risk_level", F.lit("Low Risk"))
    df = tier_counts_stream(t, ts_col="ts")
    assert set(df.columns) == {"window", "risk_level", "count"}


def test_expiries_after_the_last_wanted_row_are_left_out(spark):
    """Rows up to ``until`` get the same values, ties of an expiry with it included."""
    day = 86_400
    rows = [(f"t{i:03}", f"c{i % 3}", 1_700_000_000 + (i * 7919 % 100) * day, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "transaction_id string, customer_id string, s long, amount double").select(
        "*", F.timestamp_seconds("s").alias("timestamp")).drop("s")
    last = 1_700_000_000 + 70 * day          # 30 days before it there are rows: their expiries fall on it
    wanted = F.unix_seconds("timestamp") <= last
    cols = ["transaction_id", "customer_txn_count_30d", "customer_avg_amount_30d"]
    want = sorted(map(tuple, FE.velocity_features(df, method="range").where(wanted).select(*cols).collect()))
    for form in ("sliced", "ranges", "events"):
        got = FE.velocity_features(df, method=form, slice_days=40, hot_rows=60, until=last * 1_000_000)
        assert sorted(map(tuple, got.where(wanted).select(*cols).collect())) == want
