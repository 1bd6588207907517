"""Distinct counts, constant columns, crosstabs and one-hot levels in their one-pass forms."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from txrisk.operators import mlprep as MP
from txrisk.operators import profiling as PR
from txrisk.operators import stats


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, 0.0, "a", None, dt.datetime(2020, 1, 1), [1, None], b"x"), (1, -0.0, "a", None, dt.datetime(2020, 1, 1), [1, None], b"x"),
            (None, float("nan"), "", None, None, [1], None), (2, float("nan"), None, None, dt.datetime(2021, 1, 1), None, b"y")]
    return spark.createDataFrame(rows, "i int, d double, s string, n string, t timestamp, l array<int>, b binary")


def test_distinct_counts(awkward):
    want = awkward.agg(*[F.count_distinct(c).alias(c) for c in awkward.columns]).first().asDict()
    exact = PR.unique_by_column(awkward)
    assert {r.column_name: r.n_unique for r in exact.collect()} == want
    assert {r.column_name: r.n_unique for r in PR.unique_by_column(awkward, approx=True).collect()} == want
    assert "Expand" not in plan(PR.unique_by_column(awkward)).split("Exchange")[-1]
    assert {r.column_name: r.n_unique for r in PR.unique_by_column(awkward.limit(0)).collect()} == dict.fromkeys(want, 0)


def test_sketches_are_close(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 50_021).alias("v"))
    n = PR.unique_by_column(df, approx=True).first().n_unique
    assert abs(n - 50_021) < 0.03 * 50_021


def test_constant_columns(awkward):
    got = PR.constant_columns(awkward.select("i", "d", "s", "n", "t"))
    assert {r.column_name: r.n_unique for r in got.collect()} == {"n": 0}
    first = awkward.limit(2).select("i", "d", "s", "n", "t")
    assert {r.column_name: r.n_unique for r in PR.constant_columns(first).collect()} == {"i": 1, "d": 1, "s": 1, "n": 0, "t": 1}
    below = plan(got).split("Exchange SinglePartition")[-1]      # the one row is unpivoted above it
    assert "Expand" not in below and "distinct" not in plan(got)


def test_crosstab_is_one_scan(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, None, 5), (0, "a", None), (None, "b", 6), (1, "a", 6)], "y int, c string, k int")
    got = PR.crosstab_counts(df, "y", ["c", "k"])
    want = [(None, None, y, n) for y, n in ((1, 3), (0, 1), (None, 1))]
    want += [("c", "a", 1, 2), ("c", None, 1, 1), ("c", "a", 0, 1), ("c", "b", None, 1)]
    want += [("k", "5", 1, 2), ("k", None, 0, 1), ("k", "6", None, 1), ("k", "6", 1, 1)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    fresh = plan(PR.crosstab_counts(df, "y", ["c", "k"]))             # before it runs, when one plan is shown
    assert fresh.count("Exchange") == 1 and "Union" not in fresh


def test_fifty_thousand_levels(spark, monkeypatch):
    train = spark.range(60_000).select(F.concat(F.lit("v"), F.col("id") % 50_000).alias("big"), (F.col("id") % 3).cast("string").alias("small"))
    levels = MP.level_table(train, ["big", "small"])
    assert [tuple(r) for r in levels.agg(F.count(F.lit(1)), F.min("slot"), F.max("slot"), F.count_distinct("slot")).collect()] == [(50_003, 0, 50_002, 50_003)]
    names = sorted(f"v{i}" for i in range(50_000))
    score = spark.createDataFrame([(1, "v7", "2"), (2, "unseen", "0"), (3, None, None), (4, "v49999", "x")], "id int, big string, small string")
    want = {1: [names.index("v7"), 50_002], 2: [50_000], 3: [], 4: [names.index("v49999")]}
    assert {r.id: r.slots for r in MP.one_hot_sparse(score, levels, ["big", "small"], keep=["id"]).collect()} == want
    monkeypatch.setattr(stats, "BROADCAST_ROWS", 10)
    joined = MP.one_hot_sparse(score, levels, ["big", "small"], keep=["id"])
    assert {r.id: r.slots for r in joined.collect()} == want and "hint" not in plan(joined)


def test_numbers_are_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert [r.n for r in stats.numbered(df, ["v"], "n").orderBy("v").collect()] == list(range(1000))
    assert stats.numbered(df.limit(0), ["v"], "n").count() == 0
