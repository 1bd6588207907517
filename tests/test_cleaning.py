import numpy as np
import pytest

from txrisk.functions import expressions as X
from txrisk.operators import cleaning as CL
from txrisk.operators import stats


def test_median_and_mode(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert stats.exact_median(df, "x").collect()[0].median == 2.5
    cat = spark.createDataFrame([(v,) for v in ["b", "a", "b", "a", "Z", "Z"]], "c string")
    assert stats.modes(cat, ["c"]).collect()[0]["mode"] == "Z"


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    # one hot group holding most rows, several small groups, many ties
    g = np.concatenate([np.zeros(30000, dtype=int), rng.integers(1, 6, 3000)])
    v = np.round(rng.gamma(2.0, 50.0, g.size), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)], "g int, v double")
    q = {r.g: r for r in stats.exact_quantiles(df, "v", [0.25, 0.5, 0.75], by=["g"]).collect()}
    for key in np.unique(g):
        expect = np.quantile(v[g == key], [0.25, 0.5, 0.75])
        got = [q[key].q_0, q[key].q_1, q[key].q_2]
        assert np.allclose(got, expect, rtol=0, atol=1e-9), (key, got, expect)


def test_rounding_half_even(spark):
    df = spark.createDataFrame([(0.125, 0.12345)], "a double, b double")
    r = df.select(X.round_half_even("a", 2).alias("a"), X.risk_score("b").alias("b")).collect()[0]
    assert (r.a, r.b) == (0.12, 12.34)
    assert r.a == float(np.round(0.125, 2)) and r.b == float(np.round(0.12345 * 100, 2))


def test_filter_keeps_missing_amount(spark):
    df = spark.createDataFrame([("1", "5"), ("2", "-1"), ("3", None), ("4", "0"), ("5", "abc")], "id string, amount string")
    kept = sorted(r.id for r in CL.filter_invalid_amounts(df).collect())
    assert kept == ["1", "3", "5"]


def test_standardize_strips_all_whitespace(spark):
    df = spark.createDataFrame([("\t Web \n",), ("POS",)], "device_type string")
    assert sorted(r.device_type for r in CL.standardize_categoricals(df).collect()) == ["pos", "web"]


def test_preprocess_order_and_modes(spark):
    rows = [("t1", "c1", "2024-01-01 00:00:00", "10", "Web", "a, us", "atm", "0"),
            ("t1", "c1", "2024-01-01 00:00:00", "10", "Web", "a, us", "atm", "0"),   # duplicate
            ("t2", "c1", "2024-01-02 00:00:00", None, None, "a, us", "atm", "1"),
            ("t3", None, "2024-01-03 00:00:00", "30", "web", "a, us", "atm", "0"),    # no customer
            ("t4", "c2", "2024-01-04 00:00:00", "-3", "Web", "a, us", "atm", "0"),    # invalid amount
            ("t5", "c2", "2024-01-05 00:00:00", "abc", "web", "a, us", "atm", "0")]
    cols = "transaction_id string, customer_id string, timestamp string, amount string, merchant_category string, " \
           "location string, device_type string, is_anomaly string"
    raw = spark.createDataFrame(rows, cols)
    out = {r.transaction_id: r for r in CL.preprocess_transactions(raw).collect()}
    assert sorted(out) == ["t1", "t2", "t5"]
    # median of 10, 30, -3 (parseable, after dedupe) = 10; mode before case folding: 'Web' (2) vs 'web' (2) -> 'Web'
    assert out["t2"].amount == 10.0 and out["t2"].merchant_category == "web"
    assert out["t5"].amount is None


def test_strict_timestamp_raises(spark):
    raw = spark.createDataFrame([("t1", "c", "not a time", "1", "0")],
                                "transaction_id string, customer_id string, timestamp string, amount string, is_anomaly string")
    with pytest.raises(Exception):
        CL.coerce_types(raw, mode="strict").collect()
    assert CL.coerce_types(raw, mode="permissive").collect()[0].timestamp is None


@pytest.mark.parametrize("shape", ["normal", "heavy tail", "far apart", "two values"])
def test_density_is_the_kernel_sum(spark, shape):
    from txrisk.operators import profiling as PR
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(0, 1, 3000), "heavy tail": rng.standard_cauchy(2000), "two values": np.array([1.0, 2.0]),
         "far apart": np.concatenate([rng.normal(0, 1e-3, 500), rng.normal(1e4, 1.0, 20)])}[shape]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    got = sorted(tuple(r) for r in PR.density_curve(df, "x", digits=15).collect())
    bw = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, 200)
    want = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / bw) ** 2).sum(1) / (len(x) * bw * np.sqrt(2 * np.pi))
    assert [g[0] for g in got] == list(range(200))
    assert np.allclose([g[2] for g in got], want, rtol=0, atol=1e-13 * want.max() + 1e-15)     # the last digit kept


def test_density_without_a_bandwidth(spark):
    from txrisk.operators import profiling as PR
    for rows in ([], [(1.0,)], [(2.0,), (2.0,)], [(None,)]):
        assert PR.density_curve(spark.createDataFrame(rows, "x double"), "x").count() == 0


def test_mode_unknown_for_all_missing_column(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("a", None)], "device_type string, location string")
    out = CL.impute_mode_unknown(df.union(spark.createDataFrame([(None, None)], df.schema))).collect()
    assert sorted(r.device_type for r in out) == ["a", "a", "a", "b"]
    assert {r.location for r in out} == {"unknown"}
    assert {r.location for r in CL.impute_mode(df).collect()} == {None}


def test_clean_audit_counts(spark):
    rows = [("t1", "5"), ("t1", "5"), ("t2", None), ("t3", "-1")]
    raw = spark.createDataFrame(rows, "transaction_id string, amount string")
    a = CL.clean_audit(raw, CL.filter_invalid_amounts(CL.clean_duplicates(raw))).collect()[0]
    assert (a.rows_before, a.rows_after, a.duplicates_removed, a.missing_values, a.invalid_amounts) == (4, 2, 1, 1, 1)


@pytest.mark.parametrize("seed", [0, 1])
def test_auto_bin_count_matches_numpy(spark, seed):
    from txrisk.operators import profiling as PR
    rng = np.random.default_rng(seed)
    x = np.round(rng.lognormal(3, 1, 5000), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    assert PR.auto_bin_count(df, "v") == len(np.histogram_bin_edges(x, bins="auto")) - 1
