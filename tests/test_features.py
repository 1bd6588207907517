from datetime import datetime

import pytest

from txrisk.operators import features as FE
from txrisk.sources import adapter as A

TIMES = ["2024-01-01 00:00:00", "2024-01-31 00:00:00", "2024-01-31 00:00:00", "2024-01-31 00:00:00",
         "2024-03-01 00:00:00", "2024-03-01 00:00:01"]


def _edge(spark, amounts):
    rows = [(f"t{i + 1}", "c", datetime.fromisoformat(t), a, "x, us") for i, (t, a) in enumerate(zip(TIMES, amounts))]
    return spark.createDataFrame(rows, "transaction_id string, customer_id string, timestamp timestamp, "
                                       "amount double, location string")


@pytest.mark.parametrize("method", ["events", "sliced", "ranges", "range"])
def test_rolling_edge(spark, method):
    out = FE.velocity_features(_edge(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), method=method).orderBy("transaction_id").collect()
    assert [r.customer_txn_count_30d for r in out] == [1, 1, 2, 3, 1, 2]
    assert [r.customer_avg_amount_30d for r in out] == [1, 2, 2.5, 3, 5, 5.5]


@pytest.mark.parametrize("method", ["events", "sliced", "ranges", "range"])
def test_rolling_missing_amount(spark, method):
    df = _edge(spark, [1.0, None, 3.0, 4.0, 5.0, 6.0])
    out = FE.engineer_features(df, method=method).orderBy("transaction_id").collect()
    assert [r.customer_txn_count_30d for r in out] == [1, 1, 2, 3, 1, 2]
    assert [r.customer_avg_amount_30d for r in out] == [1, None, 3, 3.5, 5, 5.5]
    assert out[1].amount_ratio_to_avg == 1.0


def test_null_customer_defaults(spark):
    rows = [("a", None, datetime(2024, 1, 1), 10.0, "x, us"), ("b", None, datetime(2024, 1, 2), 20.0, "x, us")]
    df = spark.createDataFrame(rows, "transaction_id string, customer_id string, timestamp timestamp, "
                                     "amount double, location string")
    out = FE.velocity_features(df).orderBy("transaction_id").collect()
    assert [(r.customer_txn_count_30d, r.customer_avg_amount_30d) for r in out] == [(1.0, 10.0), (1.0, 20.0)]


def test_events_equals_range_on_orders(spark, sf_small):
    o = A.order_transactions(spark, sf_small)
    a = FE.velocity_features(o, ts_col="ts", method="events")
    b = FE.velocity_features(o, ts_col="ts", method="range")
    cols = ["transaction_id", "customer_txn_count_30d", "customer_avg_amount_30d"]
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0
    assert a.count() == b.count() == o.count()


def test_temporal_and_international(spark):
    rows = [("a", datetime(2024, 1, 6, 3, 0), "Columbus"), ("b", datetime(2024, 1, 8, 23, 0), "Paris, FR")]
    df = spark.createDataFrame(rows, "transaction_id string, timestamp timestamp, location string")
    out = FE.international_flag(FE.temporal_features(df)).orderBy("transaction_id").collect()
    assert (out[0].hour_of_day, out[0].day_of_week, out[0].is_weekend, out[0].is_international) == (3, 5, 1, 0)
    assert (out[1].hour_of_day, out[1].day_of_week, out[1].is_weekend, out[1].is_international) == (23, 0, 0, 1)


def test_threat_signatures(spark):
    rows = [("a", datetime(2024, 1, 1, 3), 2000.0, "cash_withdrawal", "Chicago, US"),
            ("b", datetime(2024, 1, 1, 12), 6000.0, "Transfer", "London, UK")]
    df = spark.createDataFrame(rows, "transaction_id string, timestamp timestamp, amount double, "
                                     "merchant_category string, location string")
    out = FE.threat_signatures(df).orderBy("transaction_id").collect()
    assert out[0].signatures == ["odd_hours"]
    assert out[1].signatures == ["high_value", "geographic"]


def test_hot_customer_dealt_by_ranges_equals_range_frame(spark):
    """One customer holds a third of the rows: the count finds it and it is dealt over ranges."""
    from pyspark.sql import functions as F
    n = 30000
    base = spark.range(n).select(
        F.format_string("T%07d", "id").alias("transaction_id"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.format_string("C%04d", F.col("id") % 500))
         .alias("customer_id"),
        # 90 days, second resolution, with repeated timestamps (ties)
        F.timestamp_seconds(F.lit(1704067200) + (F.col("id") * 7919 % (90 * 86400 // 60)) * 60).alias("timestamp"),
        F.when(F.col("id") % 17 == 0, F.lit(None)).otherwise((F.col("id") % 1000) / 10.0).alias("amount"),
        F.lit("x, us").alias("location"))
    ev = FE.velocity_features(base, method="events", hot_rows=5000)
    rg = FE.velocity_features(base, method="range")
    cols = ["transaction_id", "customer_txn_count_30d", "customer_avg_amount_30d"]
    assert ev.select(*cols).exceptAll(rg.select(*cols)).count() == 0
    plan = ev._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_cust" in plan and "_part" in plan and "Union" in plan


def test_one_minute_of_a_customer_is_spread(spark, monkeypatch):
    """A third of all rows is one customer in one microsecond, some of them with one id: no range holds more than its share."""
    from pyspark.sql import functions as F
    n, parts = 12000, 8
    id_ = F.when(F.col("id") % 3 == 0, F.when(F.col("id") < n // 2, F.lit("same")).otherwise(F.format_string("T%07d", "id")))
    base = spark.range(n).select(
        F.coalesce(id_, F.format_string("T%07d", "id")).alias("transaction_id"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.lit("cold")).alias("customer_id"),
        F.when(F.col("id") % 3 == 0, F.timestamp_seconds(F.lit(1704067200))).when(F.col("id") % 100 == 2, F.lit(None))
         .otherwise(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 900)).alias("timestamp"),
        (F.col("id") % 100 / 4).alias("amount"))
    written = []
    keep = FE.materialize
    monkeypatch.setattr(FE, "materialize", lambda df, name: written.append(keep(df, name)) or written[-1])
    got = FE.velocity_features(base, method="ranges", range_parts=parts)
    sizes = [r["count"] for r in written[0].groupBy("_part").count().collect()]
    assert len(sizes) == parts and max(sizes) < 2 * sum(sizes) / parts
    assert written[0].where("_cust = 'HOT'").select("_part").distinct().count() >= 2
    # rows that share id and time may take each other's place, so the values are held without the id
    values = lambda d: d.select("customer_id", "customer_txn_count_30d")
    want = FE.velocity_features(base, method="sliced")
    assert values(got).exceptAll(values(want)).isEmpty() and values(want).exceptAll(values(got)).isEmpty()
    others = lambda d: d.where("transaction_id <> 'same' AND NOT customer_id <=> 'HOT'").select(*base.columns, "customer_avg_amount_30d")
    assert others(got).exceptAll(others(want)).isEmpty()
    hot = got.where("customer_id = 'HOT'").agg(F.max("customer_txn_count_30d"), F.countDistinct("customer_txn_count_30d")).first()
    assert tuple(hot) == (n // 3, n // 3)


def test_velocity_plan_has_one_exchange_and_one_scan(spark, sf_small):
    import re
    o = A.order_transactions(spark, sf_small)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    for method in ("sliced", "events"):
        shape = plan(FE.velocity_features(o, ts_col="ts", method=method))
        assert len(re.findall(r"Exchange hashpartitioning", shape)) == len(re.findall(r"Exchange hashpartitioning", plan(o))) + 1
        assert shape.count("FileScan") == plan(o).count("FileScan") and "InMemoryTableScan" not in shape
