"""Selection by digits: any doubles, ties, groups of any shape, and what is gathered for a group."""
import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txrisk.operators import stats


@pytest.mark.parametrize("name,values", [
    ("any doubles", [struct.unpack(">d", bytes(b))[0] for b in np.random.default_rng(3).integers(0, 256, (4000, 8), dtype=np.uint8).tolist()]),
    ("neighbours", (1.0 + np.random.default_rng(4).integers(0, 3000, 5000) * 2.0 ** -52).tolist()),
    ("tiny", (np.random.default_rng(5).integers(-2000, 2000, 3000) * 5e-324).tolist()),
    ("one value", [7.25] * 500), ("two", [-1e308, 1e308]), ("zeros", [0.0, -0.0, 0.0, 1e-300, -1e-300])])
def test_order_statistics(spark, name, values):
    values = [v for v in values if not math.isnan(v)]
    n, ordered = len(values), sorted(values)
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = stats.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", probs).first()
    assert got.n == n
    for i, p in enumerate(probs):
        h = (n - 1) * p
        a, b = ordered[math.floor(h)], ordered[min(math.floor(h) + 1, n - 1)]
        want = a + (b - a) * (h - math.floor(h))
        assert got[f"q_{i}"] == want or (math.isnan(want) and math.isnan(got[f"q_{i}"])), (name, p)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=30))
def test_first_digit_never_falls(values):
    """The rule of the first digit, in the same arithmetic."""
    def place(v):
        size, tiny = abs(v), 2.0 ** -1000
        octave = size / tiny if size < tiny else max(1.0, min(math.log2(size) + 1001.0, 2040.0))
        return -math.floor(octave * 16) if v < 0 else math.floor(octave * 16)
    places = [place(v) for v in sorted(values)]
    assert places == sorted(places) and max(map(abs, places)) < stats.DIGIT / 2


def test_many_groups_take_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr(stats, "BROADCAST_ROWS", 3)
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), (F.col("id") * 7919 % 1009 / 7.0).alias("v"))
    got = {r.g: r for r in stats.exact_quantiles(df, "v", [0.25, 0.5], by=["g"]).collect()}
    values, g = np.arange(5000) * 7919 % 1009 / 7.0, np.arange(5000) % 7
    for k in range(7):
        assert [got[k].q_0, got[k].q_1] == pytest.approx(np.quantile(values[g == k], [0.25, 0.5]), rel=1e-12)


def test_plan_is_short(spark):
    q = stats.exact_median(spark.range(1000).select((F.col("id") / 7.0).alias("v")), "v")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 5 and "percentile_approx" not in plan


def test_null_group_and_no_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None)], "g string, v double")
    assert stats.exact_quantiles(df.where("g = 'a'"), "v", [0.5]).count() == 0
    assert [tuple(r) for r in stats.exact_quantiles(df, "v", [0.5], by=["g"]).collect()] == [(None, 2, 2.0)]
    near = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (1 + F.col("id") / 1e6).alias("v"))
    got = {r.g: r.q_0 for r in stats.exact_quantiles(near, "v", [0.5], by=["g"]).collect()}
    assert got == {g: pytest.approx(1 + np.median(np.arange(900)[np.arange(900) % 3 == (g or 0)]) / 1e6, rel=1e-15) for g in (None, 1, 2)}


def test_ranks_among_nans(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (float("nan"),)], "v double")
    got = stats.exact_quantiles(df, "v", [0.0, 1.0]).first()
    assert got.q_0 == 1.0 and np.isnan(got.q_1)
