"""History reach does not depend on the clock zone of the driver."""
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
from pyspark.sql import functions as F
from txrisk.plans.scoring import history_context_features
from txrisk.session import get_spark
spark = get_spark("local[1]", shuffle_partitions=1)
row = "transaction_id string, customer_id string, ts string, amount double, location string, merchant_category string, device_type string"
frame = lambda rows: spark.createDataFrame([(i, "c", t, 1.0, "x, us", "m", "d") for i, t in rows], row).withColumn("ts", F.to_timestamp("ts"))
path = "{path}"
frame([("h1", "2024-03-02 00:30:00"), ("h2", "2024-03-01 00:30:00")]).withColumn("day", F.to_date("ts").cast("string")).write.partitionBy("day").parquet(path)
history = spark.read.parquet(path)
out = history_context_features(frame([("n", "2024-03-31 23:30:00")]), history, ts_col="ts")
plan = out._jdf.queryExecution().executedPlan().toString()
print("COUNT", out.first()["customer_txn_count_30d"], "PARTS", "day" in plan.split("PartitionFilters: [")[-1].split("]")[0] or "PartitionFilters: [isnotnull(day" in plan)
"""


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "Europe/Berlin", "America/New_York"])
def test_reach_in_any_zone(zone, tmp_path):
    run = subprocess.run([sys.executable, "-c", CODE.replace("{path}", str(tmp_path / "h"))], cwd=ROOT, capture_output=True,
                         text=True, timeout=300, env=os.environ | {"TZ": zone, "PYTHONPATH": ROOT})
    assert "COUNT 2.0 PARTS True" in run.stdout, run.stdout + run.stderr[-1500:]
