"""Registered query: the micro-batch scoring stream (Structured Streaming).

The transactions arrive in three slices in time order, and the stream is resumed
after each; each micro-batch is scored against the history grown by the
previous ones.  The collected output must equal batch scoring of all rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from txrisk.plans import queries as Q
from txrisk.plans.registry import register
from txrisk.session import scratch_path
from txrisk.sources import adapter as A
from txrisk.streaming.scoring import start_scoring_stream

STREAM_COLS = ["transaction_id", "customer_txn_count_30d", "customer_avg_amount_30d", "amount_ratio_to_avg",
               "probability", "prediction", "risk_score", "risk_level"]
CUTS = ["2024-01-11 00:00:00", "2024-01-21 00:00:00"]


@register("stream_scoring", sql=f"""
WITH f AS ({Q._velocity_sql(A.TRANSACTIONS_SQL)}),
s AS (SELECT transaction_id, probability, prediction FROM ({A.SCORED_SQL}) WHERE model = 'amount_geo')
SELECT f.transaction_id, customer_txn_count_30d, customer_avg_amount_30d, amount_ratio_to_avg, probability,
       prediction, round_even(probability * 100, 2) AS risk_score, {Q.RISK_LEVEL_SQL} AS risk_level
FROM f JOIN s ON f.transaction_id = s.transaction_id""")
def q_stream_scoring(spark, sf):
    run = scratch_path(spark, f"txrisk-stream-{uuid.uuid4().hex[:12]}")
    src, hist, out, ckpt = (f"{run}/{x}" for x in ("source", "history", "output", "checkpoint"))
    t = A.transactions(spark, sf)
    bounds = [None] + [F.lit(c).cast("timestamp") for c in CUTS] + [None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):      # a slice arrives; the stream takes what is new and stops
        part = t
        if lo is not None:
            part = part.where(F.col("ts") >= lo)
        if hi is not None:
            part = part.where(F.col("ts") < hi)
        part.write.mode("append").parquet(src)
        start_scoring_stream(spark, src, t.schema, hist, out, ckpt, score_fn=lambda d: A.closed_form_score(d),
                             ts_col="ts").awaitTermination()
    return spark.read.parquet(out).select(*STREAM_COLS)
