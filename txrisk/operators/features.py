"""Feature engineering operators.

The 30-day velocity features follow pandas ``rolling("30D")`` semantics: the
frame is ``(t - 30 days, t]`` and rows with an equal timestamp that come later
in sort order (ties broken by transaction id) are excluded.

A row counts from its arrival ``(+1, +amount)`` at ``t`` to its expiry ``(-1, -amount)`` at
``t + 30 days``; a running sum over ``(time, expiry-before-arrival, id)`` equals the trailing frame,
including the tie rule.  Amounts are summed as DECIMAL so subtraction is exact.  All physical forms
give the same rows:

* ``method="sliced"``: running sums inside (customer, slice of ``slice_days``).  Each row goes to its
  own slice; those of the last 30 days of a slice go to the next one too, as context.  One exchange
  and one scan.
* ``method="ranges"``: all arrivals and expiries in one order (customer, time, id, row), cut into
  ranges of about equal length; running sums inside (customer, range), plus the totals of the
  customer's earlier ranges.  No task holds more than a range, even if all rows are those of one
  customer in one microsecond, at the price of two exchanges and a written table.
* ``method="events"`` (default): a count per customer first; customers with more than ``hot_rows``
  rows are computed by ``ranges``, all others ``sliced``.
* ``method="range"``: a RANGE frame on microseconds minus a tie-correction window.  One partition per
  customer; kept as the simple reference form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions import expressions as X
from txrisk.session import materialize

DAY_US = 86_400 * 1_000_000
AMOUNT_DECIMAL = "decimal(28,8)"
#: Rows of one customer that one task may sort; customers with more are dealt by ranges.
HOT_ROWS = 1_000_000

ENGINEERED_NUMERIC = ["amount", "customer_txn_count_30d", "customer_avg_amount_30d",
                      "amount_ratio_to_avg", "hour_of_day", "day_of_week"]
ENGINEERED_CATEGORICAL = ["merchant_category", "location", "device_type", "is_weekend", "is_international"]


def temporal_features(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """hour_of_day, day_of_week (Monday = 0), is_weekend."""
    return (df.withColumn("hour_of_day", X.hour_of_day(ts_col))
              .withColumn("day_of_week", X.day_of_week(ts_col))
              .withColumn("is_weekend", X.is_weekend(ts_col)))


def international_flag(df: DataFrame, location_col: str = "location") -> DataFrame:
    """is_international = location does not end with "us"."""
    return df.withColumn("is_international", X.is_international(location_col))


def _velocity_range(df, cust, ts, tid, amount, window_days):
    us = F.unix_micros(F.col(ts))
    amt = F.col(amount).cast(AMOUNT_DECIMAL)
    has_amt = F.col(amount).isNotNull().cast("long")
    frame = (Window.partitionBy(cust).orderBy(us)
             .rangeBetween(-(window_days * DAY_US) + 1, 0))
    later_ties = (Window.partitionBy(cust, us).orderBy(F.col(tid))
                  .rowsBetween(1, Window.unboundedFollowing))
    n = F.count(tid).over(frame) - F.coalesce(F.count(tid).over(later_ties), F.lit(0))
    s = F.sum(amt).over(frame) - F.coalesce(F.sum(amt).over(later_ties), F.lit(0))
    na = F.sum(has_amt).over(frame) - F.coalesce(F.sum(has_amt).over(later_ties), F.lit(0))
    return (df.withColumn("_vc", n).withColumn("_vs", s).withColumn("_vn", na))


def _matters(at, until):
    """Whether an event at ``at`` can change a sum that is asked for: none after ``until`` can."""
    return F.lit(True) if until is None else at <= F.lit(until)


def _velocity_sliced(df, cust, ts, tid, amount, window_days, until, slice_days):
    reach, length = window_days * DAY_US, max(slice_days, window_days) * DAY_US
    us = F.unix_micros(F.col(ts))
    valid = F.col(cust).isNotNull() & F.col(ts).isNotNull()
    own = F.coalesce(F.floor(us / F.lit(length)), F.lit(0))
    ends = (own + 1) * F.lit(length)          # of the row's own slice

    def event(at, kind, sign, slice_):
        return F.struct(at.alias("t"), F.lit(kind).alias("kind"), F.lit(sign).alias("sgn"), slice_.alias("slice"))

    context = valid & (us + reach > ends) & _matters(ends, until)     # still counts when the next slice begins
    expires = _matters(us + reach, until)
    events = F.array(event(us, 1, 1, own), F.when(valid & (us + reach < ends) & expires, event(us + reach, 0, -1, own)),
                     F.when(context, event(us, 2, 1, own + 1)), F.when(context & expires, event(us + reach, 0, -1, own + 1)))
    ev = df.select(
        *df.columns, F.col(tid).cast("string").alias("_id"), F.col(cust).alias("_cust"),
        F.when(F.col(tid).isNotNull(), 1).otherwise(0).cast("long").alias("_c1"),
        F.when(F.col(amount).isNotNull(), 1).otherwise(0).cast("long").alias("_n1"),
        F.coalesce(F.col(amount).cast(AMOUNT_DECIMAL), F.lit(0).cast(AMOUNT_DECIMAL)).alias("_s1"),
        F.explode(events).alias("_e")).where(F.col("_e").isNotNull())
    here = F.col("_e.kind") == 1
    ev = ev.select(*[F.when(here, F.col(c)).alias(c) for c in df.columns], "_cust",
                   F.when(F.col("_e.kind") > 0, F.col("_id")).alias("_id"),
                   F.col("_e.slice").alias("_slice"), F.col("_e.t").alias("_t"), F.col("_e.kind").alias("_kind"),
                   (F.col("_c1") * F.col("_e.sgn")).alias("_dc"), (F.col("_n1") * F.col("_e.sgn")).alias("_dn"),
                   (F.col("_s1") * F.col("_e.sgn")).cast("decimal(29,8)").alias("_ds"))
    # rows without a customer or time keep defaults; they are spread, not gathered under the null key
    spread = F.when(F.col("_cust").isNull() | F.col("_t").isNull(), F.pmod(F.xxhash64("_id"), F.lit(1024))).otherwise(F.col("_slice"))
    run = (Window.partitionBy("_cust", "_slice").orderBy("_t", F.least("_kind", F.lit(1)), "_id")
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = ev.withColumn("_slice", spread).select("*", F.sum("_dc").over(run).alias("_vc"), F.sum("_ds").over(run).alias("_vs"),
                                                 F.sum("_dn").over(run).alias("_vn"))
    return out.where(F.col("_kind") == 1).select(*df.columns, "_vc", "_vs", "_vn")


def _velocity_counted(df, cust, hot_rows, sliced, ranges):
    """``ranges(...)`` for customers with more than ``hot_rows`` rows, ``sliced(...)`` for the others."""
    hot = df.where(F.col(cust).isNotNull()).groupBy(cust).count().where(F.col("count") > hot_rows).select(cust)
    if hot.isEmpty():
        return sliced(df)
    return sliced(df.join(hot, cust, "left_anti").select(*df.columns)).unionByName(
        ranges(df.join(hot, cust, "left_semi").select(*df.columns)))


def _velocity_ranges(df, cust, ts, tid, amount, window_days, until, parts):
    us = F.unix_micros(F.col(ts))
    valid = F.col(cust).isNotNull() & F.col(ts).isNotNull()
    # One scan: every row yields its arrival and, if it has a customer and a time, its expiry; expiries carry
    # no payload. Rows without a customer or time add nothing to any sum.
    arrival = F.struct(us.alias("t"), F.lit(1).alias("kind"), F.when(valid, 1).otherwise(0).alias("sgn"))
    expiry = F.when(valid & _matters(us + F.lit(window_days * DAY_US), until), F.struct((us + F.lit(window_days * DAY_US)).alias("t"), F.lit(0).alias("kind"), F.lit(-1).alias("sgn")))
    ev = df.withColumn("_row", F.monotonically_increasing_id()).select(
        *df.columns, F.col(tid).cast("string").alias("_id"), F.col(cust).alias("_cust"), "_row",
        F.when(F.col(tid).isNotNull(), 1).otherwise(0).cast("long").alias("_c1"),
        F.when(F.col(amount).isNotNull(), 1).otherwise(0).cast("long").alias("_n1"),
        F.coalesce(F.col(amount).cast(AMOUNT_DECIMAL), F.lit(0).cast(AMOUNT_DECIMAL)).alias("_s1"),
        F.explode(F.filter(F.array(arrival, expiry), lambda e: e.isNotNull())).alias("_e"))
    ev = ev.select(*[F.when(F.col("_e.kind") == 1, F.col(c)).alias(c) for c in df.columns], "_cust", "_id", "_row",
                   F.col("_e.t").alias("_t"), F.col("_e.kind").alias("_kind"),
                   (F.col("_c1") * F.col("_e.sgn")).alias("_dc"), (F.col("_n1") * F.col("_e.sgn")).alias("_dn"),
                   (F.col("_s1") * F.col("_e.sgn")).cast("decimal(29,8)").alias("_ds"))
    # Ranges of the whole order, down to the single row: neither a customer nor a minute of one is kept together.
    # Written once, so that the sums and the totals below see the same ranges.
    order = ["_t", "_kind", "_id", "_row"]
    dealt = ev.repartitionByRange(*([parts] if parts else []), "_cust", *order)
    ev = materialize(dealt.withColumn("_part", F.spark_partition_id()), "velocity-ranges")
    # What the earlier ranges of a customer add up to: one row for each range that a customer reaches into.
    totals = ev.where(F.col("_cust").isNotNull()).groupBy("_cust", "_part").agg(*[F.sum(f"_d{x}").alias(f"_t{x}") for x in "cns"])
    before = Window.partitionBy("_cust").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_cust", "_part", *[F.sum(f"_t{x}").over(before).alias(f"_o{x}") for x in "cns"])
    within = Window.partitionBy("_cust", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ev.select("*", *[F.sum(f"_d{x}").over(within).alias(f"_r{x}") for x in "cns"]).where(F.col("_kind") == 1)
    return sums.join(offsets, ["_cust", "_part"], "left").select(
        *df.columns, *[(F.col(f"_r{x}") + F.coalesce(f"_o{x}", F.lit(0))).alias(f"_v{x}") for x in "cns"])


def velocity_features(df: DataFrame, customer_col: str = "customer_id", ts_col: str = "timestamp",
                      id_col: str = "transaction_id", amount_col: str = "amount",
                      window_days: int = 30, method: str = "events",
                      slice_days: int = 90, hot_rows: int = HOT_ROWS, range_parts: int | None = None,
                      until: int | None = None) -> DataFrame:
    """F3 + F4: customer_txn_count_30d and customer_avg_amount_30d.

    Count is over non-missing transaction ids; the mean skips missing amounts
    and is NULL when none remain.  Rows without a customer (or time) keep the
    defaults count 1 and mean = own amount, as a per-customer group-by would.
    ``range_parts``: ranges of the ``ranges`` form (default: the shuffle partitions).
    ``until``: the latest time (microseconds) whose rows are wanted; later expiries are left out, and the values
    of later rows are then not meant to be read.
    """
    cols = (customer_col, ts_col, id_col, amount_col, window_days)
    forms = {"sliced": lambda d: _velocity_sliced(d, *cols, until, slice_days),
             "ranges": lambda d: _velocity_ranges(d, *cols, until, range_parts)}
    if method == "range":
        v = _velocity_range(df, customer_col, ts_col, id_col, amount_col, window_days)
    elif method in forms:
        v = forms[method](df)
    elif method == "events":
        v = _velocity_counted(df, customer_col, hot_rows, forms["sliced"], forms["ranges"])
    else:
        raise ValueError(f"unknown velocity method {method!r}")
    grouped = F.col(customer_col).isNotNull() & F.col(ts_col).isNotNull()
    mean = F.when(F.col("_vn") > 0, F.col("_vs").cast("double") / F.col("_vn").cast("double"))
    return (v.withColumn("customer_txn_count_30d",
                         F.when(grouped, F.col("_vc").cast("double")).otherwise(F.lit(1.0)))
             .withColumn("customer_avg_amount_30d",
                         F.when(grouped, mean).otherwise(F.col(amount_col).cast("double")))
             .drop("_vc", "_vs", "_vn"))


def amount_ratio(df: DataFrame, amount_col: str = "amount") -> DataFrame:
    """amount / 30-day mean; mean 0 -> missing; missing -> 1.0."""
    avg = F.col("customer_avg_amount_30d")
    ratio = F.col(amount_col) / F.when(avg != 0, avg)
    return df.withColumn("amount_ratio_to_avg", F.coalesce(ratio, F.lit(1.0)))


def engineer_features(df: DataFrame, ts_col: str = "timestamp", customer_col: str = "customer_id",
                      id_col: str = "transaction_id", amount_col: str = "amount",
                      location_col: str = "location", method: str = "events",
                      order_by_time: bool = False, until: int | None = None) -> DataFrame:
    """F1-F5 composed.  Ordering by time is only applied when asked for; ``until`` as in :func:`velocity_features`."""
    # Row-local features are added after the velocity shuffle so they are not carried through it.
    out = (df.transform(lambda d: velocity_features(d, customer_col, ts_col, id_col, amount_col,
                                                    method=method, until=until))
             .transform(lambda d: temporal_features(d, ts_col))
             .transform(lambda d: international_flag(d, location_col))
             .transform(lambda d: amount_ratio(d, amount_col)))
    if order_by_time:
        out = out.orderBy(ts_col, id_col)
    return out


def log_amount(df: DataFrame, amount_col: str = "amount", out_col: str = "log_amount") -> DataFrame:
    """F8: log10(amount + 1)."""
    return df.withColumn(out_col, X.log_amount(amount_col))


# Fixed profile bounds of the documented threat signatures (defaults; all are parameters).
HIGH_VALUE_RANGE = (5000.0, 20000.0)
HIGH_VALUE_CATEGORIES = ["transfer", "online_retail"]
ODD_HOURS_RANGE = (2, 4)
ODD_HOURS_AMOUNT_RANGE = (1500.0, 8000.0)
ODD_HOURS_CATEGORIES = ["cash_withdrawal", "transfer"]


def threat_signatures(df: DataFrame, ts_col: str = "timestamp", amount_col: str = "amount",
                      category_col: str = "merchant_category", location_col: str = "location",
                      high_value_range=HIGH_VALUE_RANGE, high_value_categories=HIGH_VALUE_CATEGORIES,
                      odd_hours=ODD_HOURS_RANGE, odd_hours_amount=ODD_HOURS_AMOUNT_RANGE,
                      odd_hours_categories=ODD_HOURS_CATEGORIES) -> DataFrame:
    """rule flags for the three documented anomaly profiles + matched list."""
    cat = F.lower(F.col(category_col))
    amt = F.col(amount_col)
    high_value = amt.between(*high_value_range) & cat.isin(list(high_value_categories))
    geographic = X.is_international(location_col) == 1
    odd = (F.hour(F.col(ts_col)).between(*odd_hours) & amt.between(*odd_hours_amount)
           & cat.isin(list(odd_hours_categories)))
    names = F.array(F.when(high_value, F.lit("high_value")),
                    F.when(geographic, F.lit("geographic")),
                    F.when(odd, F.lit("odd_hours")))
    return (df.withColumn("sig_high_value", F.coalesce(high_value, F.lit(False)).cast("int"))
              .withColumn("sig_geographic", F.coalesce(geographic, F.lit(False)).cast("int"))
              .withColumn("sig_odd_hours", F.coalesce(odd, F.lit(False)).cast("int"))
              .withColumn("signatures", F.filter(names, lambda x: x.isNotNull())))
