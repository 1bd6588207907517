"""Registered queries: validation (V), cleaning (C) and profiling (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txrisk.functions import expressions as X

from txrisk.operators import cleaning as CL
from txrisk.operators import features as FE
from txrisk.operators import profiling as PR
from txrisk.operators import quality as QA
from txrisk.plans.registry import register
from txrisk.sources import adapter as A

T_SQL = A.TRANSACTIONS_SQL
RAW_SQL = A.RAW_TRANSACTIONS_SQL
CATS = ["merchant_category", "location", "device_type"]


def raw(spark, sf):
    return A.raw_transactions(spark, sf)


def txn(spark, sf):
    return A.transactions(spark, sf)


# ------------------------------------------------------------------ validation

def _sample_sql(cond: str, value: str = "transaction_id") -> str:
    return (f"(SELECT string_agg(coalesce(CAST(v AS VARCHAR), 'NULL'), ',' ORDER BY o, v) FROM "
            f"(SELECT transaction_id AS o, {value} AS v FROM r WHERE {cond} ORDER BY transaction_id LIMIT 5))")


def _null_keys_sql() -> str:
    parts = []
    for i, c in enumerate(["transaction_id", "customer_id", "ts", "amount"]):
        parts.append(f"SELECT {i} AS col_pos, '{c}' AS column_name, "
                     f"count(*) FILTER (WHERE {c} IS NULL) AS n_missing, "
                     f"{_sample_sql(f'{c} IS NULL')} AS first_rows FROM r")
    return f"WITH r AS ({RAW_SQL}) " + " UNION ALL ".join(parts)


@register("dq_null_keys", sql=_null_keys_sql())
def q_dq_null_keys(spark, sf):
    return QA.dq_null_keys(raw(spark, sf), ts_col="ts")


NON_NUMERIC = "amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL"
BAD_TS = "ts IS NOT NULL AND TRY_CAST(ts AS TIMESTAMP) IS NULL"
NON_POSITIVE = "TRY_CAST(amount AS DOUBLE) <= 0"


@register("dq_non_numeric", sql=f"""
WITH r AS ({RAW_SQL})
SELECT 'amount' AS column_name, count(*) FILTER (WHERE {NON_NUMERIC}) AS n_bad,
       {_sample_sql(NON_NUMERIC)} AS first_rows, {_sample_sql(NON_NUMERIC, 'amount')} AS first_values
FROM r""")
def q_dq_non_numeric(spark, sf):
    return QA.dq_non_numeric(raw(spark, sf))


@register("dq_bad_timestamp", sql=f"""
WITH r AS ({RAW_SQL})
SELECT 'ts' AS column_name, count(*) FILTER (WHERE {BAD_TS}) AS n_bad,
       {_sample_sql(BAD_TS)} AS first_rows, {_sample_sql(BAD_TS, 'ts')} AS first_values
FROM r""")
def q_dq_bad_timestamp(spark, sf):
    return QA.dq_bad_timestamp(raw(spark, sf), ts_col="ts")


@register("dq_non_positive", sql=f"""
WITH r AS ({RAW_SQL})
SELECT 'amount' AS column_name, count(*) FILTER (WHERE {NON_POSITIVE}) AS n_bad,
       {_sample_sql(NON_POSITIVE)} AS first_rows
FROM r""")
def q_dq_non_positive(spark, sf):
    return QA.dq_non_positive(raw(spark, sf))


def _report_sql() -> str:
    rows = ["SELECT 1 AS check_no, 'empty_input' AS check_name, 0 AS col_pos, CAST(NULL AS VARCHAR) AS column_name, "
            "CAST(CASE WHEN (SELECT count(*) FROM r) = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_bad, "
            "CAST(NULL AS VARCHAR) AS first_rows",
            "SELECT 2, 'missing_columns', 0, CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR)"]
    for i, c in enumerate(["transaction_id", "customer_id", "ts", "amount"]):
        rows.append(f"SELECT 3, 'null_keys', {i}, '{c}', count(*) FILTER (WHERE {c} IS NULL), "
                    f"{_sample_sql(f'{c} IS NULL')} FROM r")
    rows.append(f"SELECT 4, 'non_numeric_amount', 0, 'amount', count(*) FILTER (WHERE {NON_NUMERIC}), "
                f"{_sample_sql(NON_NUMERIC)} FROM r")
    rows.append(f"SELECT 5, 'bad_timestamp', 0, 'ts', count(*) FILTER (WHERE {BAD_TS}), "
                f"{_sample_sql(BAD_TS)} FROM r")
    rows.append(f"SELECT 6, 'non_positive_amount', 0, 'amount', count(*) FILTER (WHERE {NON_POSITIVE}), "
                f"{_sample_sql(NON_POSITIVE)} FROM r")
    return (f"WITH r AS ({RAW_SQL}), rep AS (" + " UNION ALL ".join(rows) +
            ") SELECT *, n_bad = 0 AS passed FROM rep")


@register("dq_report", sql=_report_sql())
def q_dq_report(spark, sf):
    return QA.dq_report(raw(spark, sf), ts_col="ts")


# -------------------------------------------------------------------- cleaning

DEDUP_SQL = f"SELECT DISTINCT * FROM ({RAW_SQL})"
MEDIAN_SQL = "(SELECT quantile_cont(TRY_CAST(amount AS DOUBLE), 0.5) FROM d)"


def _mode_sql(c: str) -> str:
    return (f"(SELECT {c} FROM d WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} LIMIT 1)")


def _strip_lower(c: str) -> str:
    return f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"


@register("clean_duplicates", sql=DEDUP_SQL)
def q_clean_duplicates(spark, sf):
    return CL.clean_duplicates(raw(spark, sf))


@register("impute_median", sql=f"""
WITH d AS ({DEDUP_SQL})
SELECT transaction_id, coalesce(amount, CAST({MEDIAN_SQL} AS VARCHAR)) AS amount FROM d""")
def q_impute_median(spark, sf):
    return CL.impute_median(CL.clean_duplicates(raw(spark, sf))).select("transaction_id", "amount")


@register("impute_mode", sql=f"""
WITH d AS ({DEDUP_SQL})
SELECT transaction_id, {", ".join(f"coalesce({c}, {_mode_sql(c)}) AS {c}" for c in CATS)} FROM d""")
def q_impute_mode(spark, sf):
    return CL.impute_mode(CL.clean_duplicates(raw(spark, sf))).select("transaction_id", *CATS)


@register("impute_mode_unknown", sql=f"""
WITH d AS ({DEDUP_SQL})
SELECT transaction_id, {", ".join(f"coalesce({c}, {_mode_sql(c)}, 'unknown') AS {c}" for c in CATS)} FROM d""")
def q_impute_mode_unknown(spark, sf):
    return CL.impute_mode_unknown(CL.clean_duplicates(raw(spark, sf))).select("transaction_id", *CATS)


@register("drop_null_critical", sql=f"""
SELECT * FROM ({RAW_SQL})
WHERE transaction_id IS NOT NULL AND customer_id IS NOT NULL AND ts IS NOT NULL AND is_anomaly IS NOT NULL""")
def q_drop_null_critical(spark, sf):
    return CL.drop_null_critical(raw(spark, sf), ts_col="ts")


COERCE_SELECT = """transaction_id, customer_id, CAST(TRY_CAST(ts AS TIMESTAMP) AS VARCHAR) AS ts,
       TRY_CAST(amount AS DOUBLE) AS amount, merchant_category, location, device_type,
       CAST(TRY_CAST(is_anomaly AS DOUBLE) AS INTEGER) AS is_anomaly"""


def _ts_text(df, c="ts"):
    return df.withColumn(c, F.col(c).cast("string"))


@register("coerce_types", sql=f"SELECT {COERCE_SELECT} FROM ({RAW_SQL})")
def q_coerce_types(spark, sf):
    return _ts_text(CL.coerce_types(raw(spark, sf), ts_col="ts", mode="permissive"))


@register("standardize_categoricals", sql=f"""
SELECT transaction_id, {", ".join(f"{_strip_lower(c)} AS {c}" for c in CATS)} FROM ({RAW_SQL})""")
def q_standardize(spark, sf):
    return CL.standardize_categoricals(raw(spark, sf)).select("transaction_id", *CATS)


@register("filter_invalid_amounts", sql=f"""
SELECT * FROM ({RAW_SQL}) WHERE TRY_CAST(amount AS DOUBLE) IS NULL OR TRY_CAST(amount AS DOUBLE) > 0""")
def q_filter_invalid(spark, sf):
    return CL.filter_invalid_amounts(raw(spark, sf))


CLEAN_SQL = f"""
WITH d AS ({DEDUP_SQL}),
i AS (SELECT transaction_id, customer_id, ts, coalesce(amount, CAST({MEDIAN_SQL} AS VARCHAR)) AS amount,
             {", ".join(f"coalesce({c}, {_mode_sql(c)}) AS {c}" for c in CATS)}, is_anomaly FROM d),
k AS (SELECT * FROM i WHERE transaction_id IS NOT NULL AND customer_id IS NOT NULL AND ts IS NOT NULL
                            AND is_anomaly IS NOT NULL),
c AS (SELECT transaction_id, customer_id, CAST(TRY_CAST(ts AS TIMESTAMP) AS VARCHAR) AS ts,
             TRY_CAST(amount AS DOUBLE) AS amount,
             {", ".join(f"{_strip_lower(c)} AS {c}" for c in CATS)},
             CAST(TRY_CAST(is_anomaly AS DOUBLE) AS INTEGER) AS is_anomaly FROM k)
SELECT * FROM c WHERE amount IS NULL OR amount > 0"""


def clean(spark, sf):
    return CL.preprocess_transactions(raw(spark, sf), ts_col="ts", mode="permissive")


@register("preprocess_transactions", sql=CLEAN_SQL, headline=True)
def q_preprocess(spark, sf):
    return _ts_text(clean(spark, sf))


A_RAW_COLS = ["transaction_id", "customer_id", "ts", "amount", "merchant_category", "location",
              "device_type", "is_anomaly"]


@register("clean_audit", sql=f"""
WITH r AS ({RAW_SQL})
SELECT count(*) AS rows_before, (SELECT count(*) FROM ({CLEAN_SQL})) AS rows_after,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r)) AS duplicates_removed,
       CAST(sum({" + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in A_RAW_COLS)}) AS BIGINT) AS missing_values,
       count(*) FILTER (WHERE TRY_CAST(amount AS DOUBLE) <= 0) AS invalid_amounts,
       8 AS columns_before, 8 AS columns_after
FROM r""")
def q_clean_audit(spark, sf):
    r = raw(spark, sf)
    return CL.clean_audit(r, CL.preprocess_transactions(r, ts_col="ts", mode="permissive"))


# ------------------------------------------------------------------- profiling

TXN_TYPES = [("transaction_id", "string"), ("customer_id", "string"), ("ts", "timestamp"),
             ("amount", "double"), ("merchant_category", "string"), ("location", "string"),
             ("device_type", "string"), ("is_anomaly", "int")]
RAW_COLS = [c for c, _ in TXN_TYPES]


@register("profile_summary", sql=f"""
WITH r AS ({RAW_SQL}),
n AS (SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r)) AS n_duplicates FROM r)
{" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, 'string' AS dtype, "
    f"(SELECT count(*) FILTER (WHERE {c} IS NULL) FROM r) AS n_missing, n_rows, 8 AS n_columns, n_duplicates FROM n"
    for i, c in enumerate(RAW_COLS))}""")
def q_profile_summary(spark, sf):
    return PR.profile_summary(raw(spark, sf))


@register("missing_by_column", sql=f"""
WITH r AS ({RAW_SQL})
{" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM r"
                    for c in RAW_COLS)}""")
def q_missing_by_column(spark, sf):
    return PR.missing_by_column(raw(spark, sf))


@register("unique_by_column", sql=f"""
WITH t AS ({T_SQL})
{" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique FROM t" for c in RAW_COLS)}""")
def q_unique_by_column(spark, sf):
    return PR.unique_by_column(txn(spark, sf))


@register("duplicate_row_count", sql=f"""
WITH r AS ({RAW_SQL})
SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM r)) AS n_duplicates FROM r""")
def q_duplicate_rows(spark, sf):
    return PR.duplicate_row_count(raw(spark, sf))


SCORED_COLS = ["transaction_id", "customer_id", "amount", "location", "label", "model", "probability",
               "prediction"]


@register("constant_columns", sql=f"""
WITH s AS (SELECT * FROM ({A.SCORED_SQL}) WHERE model = 'amount_geo'),
u AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique FROM s"
                          for c in SCORED_COLS)})
SELECT * FROM u WHERE n_unique <= 1""")
def q_constant_columns(spark, sf):
    s = A.scored_transactions(spark, sf).where(F.col("model") == "amount_geo").select(*SCORED_COLS)
    return PR.constant_columns(s)


@register("high_cardinality_columns", sql=f"""
WITH t AS ({T_SQL}),
u AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_unique FROM t"
                          for c, ty in TXN_TYPES if ty == "string")})
SELECT * FROM u WHERE n_unique > 20""")
def q_high_cardinality(spark, sf):
    return PR.high_cardinality_columns(txn(spark, sf))


@register("target_distribution", sql=f"""
WITH t AS ({T_SQL})
SELECT is_anomaly, count(*) AS count, CAST(count(*) * 100.0 / sum(count(*)) OVER () AS DOUBLE) AS percent
FROM t GROUP BY is_anomaly""")
def q_target_distribution(spark, sf):
    return PR.target_distribution(txn(spark, sf))


def _hist_sql(src: str, expr: str, bins_sql: str) -> str:
    return f"""
WITH x AS (SELECT {expr} AS x FROM ({src}) WHERE {expr} IS NOT NULL),
p AS (SELECT min(x) AS lo, max(x) AS hi, {bins_sql} AS nb FROM x),
w AS (SELECT lo, hi, nb, (hi - lo) / CAST(nb AS DOUBLE) AS width FROM p),
b AS (SELECT CAST(CASE WHEN width > 0 THEN least(floor((x - lo) / width), nb - 1) ELSE 0 END AS INTEGER) AS bin
      FROM x, w),
c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range((SELECT nb FROM p)))
SELECT g.bin, lo + g.bin * width AS bin_lo, lo + (g.bin + 1) * width AS bin_hi,
       CAST(coalesce(c.count, 0) AS BIGINT) AS count
FROM g CROSS JOIN w LEFT JOIN c ON g.bin = c.bin"""


AUTO_BINS_SQL = """CAST(greatest(1, ceil((max(x) - min(x)) / least(
    greatest(2.0 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) * pow(count(x), -1.0 / 3.0),
             (max(x) - min(x)) / sqrt(count(x)) / 2),
    (max(x) - min(x)) / (log2(count(x)) + 1.0)))) AS INTEGER)"""


@register("log_amount_histogram", sql=_hist_sql(T_SQL, "log10(amount + 1)", AUTO_BINS_SQL))
def q_log_hist(spark, sf):
    return PR.log_amount_histogram(txn(spark, sf))


@register("fixed_bin_histogram", sql=_hist_sql(T_SQL, "amount", "30"))
def q_fixed_hist(spark, sf):
    return PR.fixed_bin_histogram(txn(spark, sf), "amount", bins=30)


@register("amount_box_stats", sql=f"""
WITH t AS ({T_SQL}),
q AS (SELECT is_anomaly, count(amount) AS n, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS median,
             quantile_cont(amount, 0.75) AS q3 FROM t WHERE amount IS NOT NULL GROUP BY is_anomaly)
SELECT q.is_anomaly, n, q1, median, q3,
       min(amount) FILTER (WHERE amount >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
       max(amount) FILTER (WHERE amount <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
       count(*) FILTER (WHERE amount < q1 - 1.5 * (q3 - q1) OR amount > q3 + 1.5 * (q3 - q1)) AS n_outliers,
       q3 - q1 AS iqr
FROM t JOIN q ON t.is_anomaly = q.is_anomaly GROUP BY q.is_anomaly, n, q1, median, q3""")
def q_box_stats(spark, sf):
    return PR.amount_box_stats(txn(spark, sf))


@register("category_frequency", sql=f"""
SELECT merchant_category, count(*) AS count FROM ({T_SQL}) GROUP BY merchant_category""")
def q_category_frequency(spark, sf):
    return PR.category_frequency(txn(spark, sf))


# Levels present in the test tables (fixed values of the generated data).
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
DEVICES = ["atm", "mobile", "pos", "web"]
DUMMIES = [("merchant_category", v) for v in EVENT_TYPES] + [("device_type", v) for v in DEVICES]


@register("one_hot_dummies", sql=f"""
SELECT transaction_id, {", ".join(f"CAST({c} = '{v}' AS INTEGER) AS {c}_{v}" for c, v in DUMMIES)}
FROM ({T_SQL})""")
def q_one_hot(spark, sf):
    return PR.one_hot_dummies(txn(spark, sf), ["merchant_category", "device_type"], keep=["transaction_id"])


@register("correlation_matrix", sql=f"""
WITH t AS ({T_SQL}),
v AS (SELECT DISTINCT 'merchant_category' AS c, merchant_category AS v FROM t WHERE merchant_category IS NOT NULL
      UNION ALL SELECT DISTINCT 'device_type', device_type FROM t WHERE device_type IS NOT NULL),
d AS (SELECT transaction_id, 'amount' AS col, CAST(amount AS DOUBLE) AS x FROM t
      UNION ALL SELECT transaction_id, 'is_anomaly', CAST(is_anomaly AS DOUBLE) FROM t
      UNION ALL SELECT transaction_id, c || '_' || v, CAST(CASE c WHEN 'device_type' THEN device_type ELSE merchant_category END = v AS DOUBLE)
                FROM t CROSS JOIN v)
SELECT a.col AS col_a, b.col AS col_b, round_even(corr(a.x, b.x), 9) AS corr
FROM d AS a JOIN d AS b USING (transaction_id) GROUP BY a.col, b.col""")
def q_correlation(spark, sf):
    t = txn(spark, sf)
    d = PR.one_hot_dummies(t, ["merchant_category", "device_type"], keep=["amount", "is_anomaly"])
    return PR.correlation_matrix(d, d.columns)      # whatever levels the data has


@register("anomaly_rate_by_device", sql=f"""
SELECT device_type, avg(is_anomaly) * 100 AS anomaly_rate FROM ({T_SQL}) GROUP BY device_type""")
def q_rate_device(spark, sf):
    return PR.anomaly_rate_by(txn(spark, sf), "device_type")


@register("anomaly_rate_top_locations", sql=f"""
WITH t AS ({T_SQL}),
c AS (SELECT location, count(*) AS n, avg(is_anomaly) * 100 AS anomaly_rate FROM t GROUP BY location
      ORDER BY n DESC, location LIMIT 10)
SELECT location, n, anomaly_rate FROM c""")
def q_rate_top_locations(spark, sf):
    return PR.anomaly_rate_top_locations(txn(spark, sf))


@register("density_curve", sql=f"""
WITH x AS (SELECT log10(amount + 1) AS x FROM ({T_SQL}) WHERE amount IS NOT NULL),
s AS (SELECT count(x) AS n, stddev_samp(x) * pow(CAST(count(x) AS DOUBLE), -0.2) AS bw,
             min(x) AS mn, max(x) AS mx FROM x),
g AS (SELECT mn - 3.0 * bw AS start, ((mx + 3.0 * bw) - (mn - 3.0 * bw)) / 199.0 AS step, bw, n FROM s),
pts AS (SELECT CAST(range AS INTEGER) AS point FROM range(200)),
d AS (SELECT x, count(*) AS c FROM x GROUP BY x)
SELECT point, round_even(start + point * step, 9) AS x,
       round_even(sum(c * exp(-0.5 * pow((start + point * step - d.x) / bw, 2))) / (n * bw * sqrt(2 * pi())), 9)
         AS density
FROM pts CROSS JOIN g CROSS JOIN d GROUP BY point, start, step, n, bw""")
def q_density(spark, sf):
    return PR.density_curve(FE.log_amount(txn(spark, sf)), "log_amount")


@register("dataset_kpis", sql=f"""
SELECT count(*) AS n_rows, avg(is_anomaly) AS anomaly_rate, count(DISTINCT customer_id) AS n_customers,
       round_even(avg(amount), 6) AS mean_amount FROM ({T_SQL})""")
def q_dataset_kpis(spark, sf):
    k = PR.dataset_kpis(txn(spark, sf))
    return k.withColumn("mean_amount", X.round_half_even("mean_amount", 6))


@register("sample_head", sql=f"""
SELECT transaction_id, customer_id, CAST(ts AS VARCHAR) AS ts, amount, merchant_category, location, device_type,
       is_anomaly FROM ({T_SQL}) ORDER BY transaction_id LIMIT 10""")
def q_sample_head(spark, sf):
    return PR.sample_head(txn(spark, sf), 10).withColumn("ts", F.col("ts").cast("string"))


@register("crosstab_counts", sql=f"""
WITH t AS ({T_SQL})
SELECT CAST(NULL AS VARCHAR) AS dimension, CAST(NULL AS VARCHAR) AS value, is_anomaly, count(*) AS count
FROM t GROUP BY is_anomaly
UNION ALL
SELECT 'device_type', device_type, is_anomaly, count(*) FROM t GROUP BY device_type, is_anomaly
UNION ALL
SELECT 'merchant_category', merchant_category, is_anomaly, count(*) FROM t GROUP BY merchant_category, is_anomaly""")
def q_crosstab(spark, sf):
    return PR.crosstab_counts(txn(spark, sf), "is_anomaly", ["device_type", "merchant_category"])
