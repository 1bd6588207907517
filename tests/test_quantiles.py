"""Exact quantiles of a large group and of uneven groups."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from txrisk.operators import stats


def test_large_and_uneven_groups(spark):
    n = 400_000
    df = spark.range(n).select((F.col("id") * 7919 % 1_000_003 / 7.0).alias("v"), (F.col("id") % 50 == 0).cast("int").alias("g"))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    values = np.arange(n) * 7919 % 1_000_003 / 7.0
    got = stats.exact_quantiles(df, "v", probs).first()
    assert [got[f"q_{i}"] for i in range(5)] == pytest.approx(np.quantile(values, probs), rel=1e-12)
    of = {r.g: r for r in stats.exact_quantiles(df, "v", [0.5], by=["g"]).collect()}
    for g in (0, 1):
        mine = values[(np.arange(n) % 50 == 0) == bool(g)]
        assert of[g].n == len(mine) and of[g].q_0 == pytest.approx(np.median(mine), rel=1e-12)
