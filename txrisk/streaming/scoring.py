"""Structured Streaming form of batch scoring.

Incoming transaction files are scored micro-batch by micro-batch with
``foreachBatch``: the 30-day velocity features need the customer's earlier
transactions, which a stateless stream operator cannot see, so every
micro-batch is joined to the history table (F7) and then appended to it.
Each epoch writes to its own ``epoch=<id>`` partition with overwrite, so a
replayed epoch after a failure rewrites the same files (exactly-once output).

``tier_counts_stream`` is the streaming form of the tier counts (R6) per
event-time window, with a watermark bounding state and late data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.functions import expressions as X
from txrisk.plans.scoring import category_counts, history_context_features
from txrisk.session import release_shared
from txrisk.sources.io import stored_table


def _append_epoch(df: DataFrame, path: str, epoch_id: int, partition_by=()) -> None:
    (df.withColumn("epoch", F.lit(int(epoch_id)))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_by, "epoch").parquet(path))


def score_micro_batch(batch: DataFrame, epoch_id: int, history_path: str, output_path: str,
                      score_fn, ts_col: str = "timestamp", low=X.DEFAULT_LOW_RISK_THRESHOLD,
                      high=X.DEFAULT_HIGH_RISK_THRESHOLD) -> None:
    """Features in history context -> probability -> score and tier; then grow the history."""
    spark = batch.sparkSession
    counts_path = f"{history_path.rstrip('/')}_category_counts"
    history = stored_table(spark, history_path)
    counts = stored_table(spark, counts_path)
    if history is not None:
        history = history.where(F.col("epoch") != int(epoch_id)).drop("epoch")   # keeps `day` for pruning
    if counts is not None:
        counts = counts.where(F.col("epoch") != int(epoch_id))
    batch = batch.persist()      # read for its bounds, its features and the history
    # exclude_overlap: rows sent again in a later epoch must not count twice
    # (the anti join runs after the history is pruned to the 30-day reach).
    feats = history_context_features(batch, history, ts_col=ts_col, exclude_overlap=True, history_counts=counts)
    scored = score_fn(feats)
    out = scored.select(*batch.columns, "prediction", "probability",
                        X.risk_score("probability").alias("risk_score"),
                        X.risk_level("probability", low, high).alias("risk_level"),
                        "customer_txn_count_30d", "customer_avg_amount_30d", "amount_ratio_to_avg")
    _append_epoch(out, output_path, epoch_id)
    # History partitioned by day, so the next batches read only the days in reach.
    _append_epoch(batch.withColumn("day", F.to_date(ts_col).cast("string")), history_path, epoch_id, ["day"])
    # Value counts beside the history: a mode needs no scan of it.
    _append_epoch(category_counts(batch), counts_path, epoch_id)
    batch.unpersist()
    release_shared()      # what this epoch's operators kept


def start_scoring_stream(spark: SparkSession, source_path: str, schema, history_path: str, output_path: str,
                         checkpoint_location: str, score_fn, ts_col: str = "timestamp", fmt: str = "parquet",
                         max_files_per_trigger: int | None = None, available_now: bool = True):
    """Start the scoring stream; returns the ``StreamingQuery``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    stream = reader.load(source_path)
    writer = (stream.writeStream
              .foreachBatch(lambda df, epoch: score_micro_batch(df, epoch, history_path, output_path,
                                                                score_fn, ts_col))
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def tier_counts_stream(scored_stream: DataFrame, ts_col: str = "timestamp", window: str = "1 hour",
                       watermark: str = "2 hours", level_col: str = "risk_level") -> DataFrame:
    """R6 per event-time window on a stream; late rows beyond the watermark are dropped by design."""
    return (scored_stream.withWatermark(ts_col, watermark)
            .groupBy(F.window(ts_col, window).alias("window"), level_col)
            .agg(F.count(F.lit(1)).alias("count")))
