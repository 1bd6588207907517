"""Batch-scoring feature plan (F7): features of a new batch in the context of history.

The new batch and the (optional) history table are unioned, categoricals are
imputed (mode over history + batch, "unknown" when a column is empty) and
standardised, features are computed on the union and only the new rows are
kept.  Only history rows that can fall in a new row's 30-day frame are fed to
the window: customers of the batch (semi join) with a time after the earliest
new time minus 30 days.  The mode is over history and batch; it is not needed
for a batch without missing categories, and ``history_counts`` (value counts
kept beside a growing history) spares reading the whole history for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.functions import expressions as X
from txrisk.operators import cleaning as CL
from txrisk.operators import features as FE

NEW_FLAG = "_is_new_txn"


def _prepare(df: DataFrame, ts_col: str) -> DataFrame:
    out = df.withColumn(ts_col, F.col(ts_col).cast("timestamp")) if dict(df.dtypes).get(ts_col) == "string" \
        else df
    if dict(out.dtypes).get("amount") == "string":
        out = out.withColumn("amount", F.col("amount").try_cast("double"))
    elif "amount" in out.columns:
        out = out.withColumn("amount", F.col("amount").cast("double"))
    return out


def category_counts(df: DataFrame, cats=None) -> DataFrame:
    """(k, v, n): how often each value of each categorical column stands in ``df``."""
    cats = [c for c in (CL.CATEGORICAL_COLUMNS if cats is None else cats) if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in cats]).cast(
        "array<struct<k:string,v:string>>")
    return df.select(F.inline(pairs)).where(F.col("v").isNotNull()).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))


def history_context_features(new: DataFrame, history: DataFrame | None = None, ts_col: str = "timestamp",
                             customer_col: str = "customer_id", id_col: str = "transaction_id",
                             exclude_overlap: bool = False, window_days: int = 30,
                             method: str = "events", day_col: str = "day",
                             history_counts: DataFrame | None = None) -> DataFrame:
    """engineered features for the rows of ``new`` only, using ``history`` as context.

    ``exclude_overlap=True`` drops history rows whose id is also in the batch
    (by default they count twice, as in the reference).  A history table
    partitioned by ``day_col`` (yyyy-MM-dd) is pruned to the days in reach.
    ``history_counts``: the :func:`category_counts` of the history, if they are kept.
    """
    batch = _prepare(new, ts_col).withColumn(NEW_FLAG, F.lit(True))
    cats = [c for c in CL.CATEGORICAL_COLUMNS if c in batch.columns]
    if history is not None:
        common = [c for c in new.columns if c in history.columns]
        hist = _prepare(history.select(*common), ts_col).withColumn(NEW_FLAG, F.lit(False))
        if exclude_overlap:
            hist = hist.join(new.select(id_col), id_col, "left_anti")
        combined = hist.unionByName(batch, allowMissingColumns=True)
    else:
        hist = None
        combined = batch
    # One pass over the batch tells its earliest and latest time and whether a mode is needed at all.
    at = F.col(ts_col).cast("timestamp")
    seen = batch.agg(F.unix_micros(F.min(at)).alias("us"), F.unix_micros(F.max(at)).alias("until"),
                     *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cats)]).first()
    missing = [c for i, c in enumerate(cats) if seen[f"n{i}"]]
    if history is not None and history_counts is not None:
        modes = CL.mode_fills_from_counts(
            history_counts.select("k", "v", "n").unionByName(category_counts(batch, missing)), missing)
    else:
        modes = CL.mode_fills(combined, missing)
    if hist is not None:
        if seen["us"] is None:
            reach = hist.limit(0)
        else:
            # The reach as a constant of the engine, in microseconds of universal time: pushed into the history
            # scan, and a partition filter (of the session zone's days, as written) where it has days.
            us = seen["us"] - int(window_days) * 86_400_000_000
            cutoff = F.timestamp_micros(F.lit(us))
            kind = dict(history.dtypes)[ts_col]
            reach = history.where(F.col(ts_col) > (cutoff.cast(kind) if kind.startswith("timestamp") else cutoff))
            if day_col in history.columns:
                reach = reach.where(F.col(day_col) >= F.date_format(cutoff, "yyyy-MM-dd"))
            reach = _prepare(reach.select(*common), ts_col).withColumn(NEW_FLAG, F.lit(False))
            if exclude_overlap:
                reach = reach.join(new.select(id_col), id_col, "left_anti")
        reach = reach.join(batch.select(customer_col).distinct(), customer_col, "left_semi")
        work = reach.unionByName(batch, allowMissingColumns=True)
    else:
        work = batch
    for c in cats:
        work = work.withColumn(c, X.strip_lower(F.coalesce(F.col(c), *([modes[c]] if c in modes else []), F.lit("unknown"))))
    feats = FE.engineer_features(work, ts_col=ts_col, customer_col=customer_col, id_col=id_col, method=method,
                                until=seen["until"])      # what expires after the batch's last row changes none of its rows
    return feats.where(F.col(NEW_FLAG)).drop(NEW_FLAG)
