"""Registered queries over the test tables, each with its DuckDB oracle.

Time columns leave the queries as text (``CAST(ts AS STRING)``, identical in
both engines) so result comparison does not depend on timestamp units.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from txrisk.functions import expressions as X
from txrisk.operators import features as FE
from txrisk.operators import risk as RK
from txrisk.plans.registry import register
from txrisk.sources import adapter as A

T_SQL = A.TRANSACTIONS_SQL
RAW_SQL = A.RAW_TRANSACTIONS_SQL
ORD_SQL = A.ORDER_TRANSACTIONS_SQL
SCORED_SQL = A.SCORED_SQL
W_US = 30 * 86_400 * 1_000_000


def txn(spark, sf):
    return A.transactions(spark, sf)


def features_of(spark, sf, method="events"):
    return FE.engineer_features(txn(spark, sf), ts_col="ts", method=method)


# Velocity frame in SQL: RANGE over microseconds minus later equal-time rows.
def _velocity_sql(src: str, extra_cols: str = "") -> str:
    return f"""
WITH t AS ({src}),
v AS (SELECT *, epoch_us(ts) AS us, CAST(amount AS DECIMAL(28,8)) AS amt FROM t),
f AS (
SELECT *,
  count(transaction_id) OVER w - coalesce(count(transaction_id) OVER tie, 0) AS vc,
  sum(amt) OVER w - coalesce(sum(amt) OVER tie, 0) AS vs,
  count(amt) OVER w - coalesce(count(amt) OVER tie, 0) AS vn
FROM v
WINDOW w AS (PARTITION BY customer_id ORDER BY us RANGE BETWEEN {W_US - 1} PRECEDING AND CURRENT ROW),
       tie AS (PARTITION BY customer_id, us ORDER BY transaction_id
               ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
g AS (
SELECT *, CAST(vc AS DOUBLE) AS customer_txn_count_30d,
       CASE WHEN vn > 0 THEN CAST(vs AS DOUBLE) / CAST(vn AS DOUBLE) END AS customer_avg_amount_30d
FROM f)
SELECT transaction_id, customer_id{extra_cols}, customer_txn_count_30d, customer_avg_amount_30d,
       coalesce(amount / CASE WHEN customer_avg_amount_30d <> 0 THEN customer_avg_amount_30d END, 1.0)
         AS amount_ratio_to_avg
FROM g
"""


FEATURE_EXTRA_SQL = """,
       CAST(hour(ts) AS INTEGER) AS hour_of_day,
       CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
       CAST(CASE WHEN isodow(ts) IN (6, 7) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
       CAST(CASE WHEN suffix(lower(location), 'us') THEN 0 ELSE 1 END AS INTEGER) AS is_international"""

FEATURE_COLS = ["transaction_id", "customer_id", "hour_of_day", "day_of_week", "is_weekend",
                "is_international", "customer_txn_count_30d", "customer_avg_amount_30d",
                "amount_ratio_to_avg"]


# ---------------------------------------------------------------- features (F)

@register("engineer_features", sql=_velocity_sql(T_SQL, FEATURE_EXTRA_SQL), headline=True)
def q_engineer_features(spark, sf):
    return features_of(spark, sf).select(*FEATURE_COLS)


@register("temporal_features", sql=f"""
WITH t AS ({T_SQL})
SELECT transaction_id, CAST(hour(ts) AS INTEGER) AS hour_of_day,
       CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
       CAST(CASE WHEN isodow(ts) IN (6, 7) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend
FROM t""")
def q_temporal(spark, sf):
    return FE.temporal_features(txn(spark, sf), "ts").select("transaction_id", "hour_of_day", "day_of_week",
                                                              "is_weekend")


@register("is_international", sql=f"""
WITH t AS ({T_SQL})
SELECT transaction_id, location,
       CAST(CASE WHEN suffix(lower(location), 'us') THEN 0 ELSE 1 END AS INTEGER) AS is_international
FROM t""")
def q_international(spark, sf):
    return FE.international_flag(txn(spark, sf)).select("transaction_id", "location", "is_international")


@register("velocity_count_30d", sql=f"""
SELECT transaction_id, customer_id, customer_txn_count_30d
FROM ({_velocity_sql(ORD_SQL)})""", headline=True)
def q_velocity_count(spark, sf):
    o = A.order_transactions(spark, sf)
    return FE.velocity_features(o, ts_col="ts", method="events") \
        .select("transaction_id", "customer_id", "customer_txn_count_30d")


@register("velocity_avg_30d", sql=f"""
SELECT transaction_id, customer_id, customer_avg_amount_30d
FROM ({_velocity_sql(ORD_SQL)})""")
def q_velocity_avg(spark, sf):
    o = A.order_transactions(spark, sf)
    return FE.velocity_features(o, ts_col="ts", method="events") \
        .select("transaction_id", "customer_id", "customer_avg_amount_30d")


@register("velocity_range_form", sql=f"""
SELECT transaction_id, customer_id, customer_txn_count_30d, customer_avg_amount_30d
FROM ({_velocity_sql(ORD_SQL)})""")
def q_velocity_range(spark, sf):
    o = A.order_transactions(spark, sf)
    return FE.velocity_features(o, ts_col="ts", method="range") \
        .select("transaction_id", "customer_id", "customer_txn_count_30d", "customer_avg_amount_30d")


@register("amount_ratio", sql=f"""
SELECT transaction_id, amount_ratio_to_avg FROM ({_velocity_sql(ORD_SQL)})""")
def q_amount_ratio(spark, sf):
    o = A.order_transactions(spark, sf)
    return FE.velocity_features(o, ts_col="ts").transform(FE.amount_ratio) \
        .select("transaction_id", "amount_ratio_to_avg")


@register("log_amount", sql=f"""
WITH t AS ({T_SQL}) SELECT transaction_id, round_even(log10(amount + 1), 12) AS log_amount FROM t""")
def q_log_amount(spark, sf):
    # log10 may differ in the last bit between math libraries: compare at 12 decimals
    return FE.log_amount(txn(spark, sf)).select("transaction_id", X.round_half_even("log_amount", 12).alias("log_amount"))


SIGNATURE_SRC_SQL = """
SELECT printf('EVT%010d', event_id) AS transaction_id, CAST(ts AS TIMESTAMP) AS ts, value * 100 AS amount,
       CASE event_id % 4 WHEN 0 THEN 'transfer' WHEN 1 THEN 'online_retail' WHEN 2 THEN 'cash_withdrawal' ELSE 'grocery' END
         AS merchant_category,
       CASE WHEN user_id % 3 = 0 THEN 'London, UK' ELSE 'Chicago, US' END AS location
FROM events"""


def signature_source(spark, sf):
    """Events as transactions, at all hours, with a category and a location from their numbers."""
    e = A.table(spark, sf, "events")
    kind = F.col("event_id") % 4
    return e.select(
        F.format_string("EVT%010d", F.col("event_id")).alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("ts"), (F.col("value") * 100).alias("amount"),
        F.when(kind == 0, "transfer").when(kind == 1, "online_retail").when(kind == 2, "cash_withdrawal")
         .otherwise("grocery").alias("merchant_category"),
        F.when(F.col("user_id") % 3 == 0, "London, UK").otherwise("Chicago, US").alias("location"))


@register("threat_signatures", sql=f"""
WITH o AS ({SIGNATURE_SRC_SQL}),
s AS (
SELECT transaction_id,
  CAST(coalesce(amount BETWEEN 5000 AND 20000 AND lower(merchant_category) IN ('transfer', 'online_retail'), false) AS INTEGER) AS sig_high_value,
  CAST(coalesce(NOT suffix(lower(location), 'us'), false) AS INTEGER) AS sig_geographic,
  CAST(coalesce(hour(ts) BETWEEN 2 AND 4 AND amount BETWEEN 1500 AND 8000
                AND lower(merchant_category) IN ('cash_withdrawal', 'transfer'), false) AS INTEGER) AS sig_odd_hours
FROM o)
SELECT transaction_id, sig_high_value, sig_geographic, sig_odd_hours,
       concat_ws(',', CASE WHEN sig_high_value = 1 THEN 'high_value' END,
                      CASE WHEN sig_geographic = 1 THEN 'geographic' END,
                      CASE WHEN sig_odd_hours = 1 THEN 'odd_hours' END) AS signatures
FROM s""")
def q_threat_signatures(spark, sf):
    s = FE.threat_signatures(signature_source(spark, sf), ts_col="ts")
    return s.select("transaction_id", "sig_high_value", "sig_geographic", "sig_odd_hours",
                    F.array_join("signatures", ",").alias("signatures"))


# ------------------------------------------------------- minimal risk slice (R)

def scored(spark, sf, model="amount_geo"):
    s = A.scored_transactions(spark, sf)
    return s.where(F.col("model") == model) if model else s


def _scored_sql(model="amount_geo"):
    return f"(SELECT * FROM ({SCORED_SQL}) WHERE model = '{model}')"


@register("risk_score", sql=f"""
SELECT transaction_id, probability, round_even(probability * 100, 2) AS risk_score FROM {_scored_sql()}""")
def q_risk_score(spark, sf):
    return RK.risk_score(scored(spark, sf)).select("transaction_id", "probability", "risk_score")


RISK_LEVEL_SQL = """CASE WHEN probability < 0.2 THEN 'Low Risk' WHEN probability < 0.6 THEN 'Medium Risk'
            ELSE 'High Risk' END"""


@register("risk_level", sql=f"""
SELECT transaction_id, probability, {RISK_LEVEL_SQL} AS risk_level FROM {_scored_sql()}""")
def q_risk_level(spark, sf):
    return RK.risk_level(scored(spark, sf)).select("transaction_id", "probability", "risk_level")


@register("risk_summary", sql=f"""
WITH s AS (SELECT {RISK_LEVEL_SQL} AS risk_level FROM {_scored_sql()}),
a AS (SELECT count(*) AS total_predictions,
             count(*) FILTER (WHERE risk_level = 'High Risk') AS high_risk_cases,
             count(*) FILTER (WHERE risk_level = 'Medium Risk') AS medium_risk_cases,
             count(*) FILTER (WHERE risk_level = 'Low Risk') AS low_risk_cases FROM s)
SELECT total_predictions, high_risk_cases, medium_risk_cases, low_risk_cases,
       round_even(high_risk_cases * 100.0 / total_predictions, 2) AS percentage_high_risk,
       round_even(medium_risk_cases * 100.0 / total_predictions, 2) AS percentage_medium_risk,
       round_even(low_risk_cases * 100.0 / total_predictions, 2) AS percentage_low_risk,
       CAST(0.2 AS DOUBLE) AS low_risk_threshold, CAST(0.6 AS DOUBLE) AS high_risk_threshold
FROM a""", headline=True)
def q_risk_summary(spark, sf):
    return RK.risk_summary(RK.risk_level(scored(spark, sf)))


@register("transaction_risk_table", sql=f"""
WITH f AS ({_velocity_sql(T_SQL, FEATURE_EXTRA_SQL)}),
s AS (SELECT transaction_id, probability FROM {_scored_sql()})
SELECT f.transaction_id, customer_id, hour_of_day, is_international, customer_txn_count_30d,
       customer_avg_amount_30d, amount_ratio_to_avg, probability,
       round_even(probability * 100, 2) AS risk_score, {RISK_LEVEL_SQL} AS risk_level
FROM f JOIN s ON f.transaction_id = s.transaction_id""", headline=True)
def q_transaction_risk_table(spark, sf):
    return flagship(spark, sf)


def flagship(spark, sf):
    """Per-transaction features with the score, risk score and tier.

    The score is row-local, so it is computed on the feature rows directly:
    one shuffle (the velocity window) for the whole query, no join.
    """
    f = features_of(spark, sf)
    j = A.closed_form_score(f, model="amount_geo", ts_col="ts")
    j = RK.risk_level(RK.risk_score(j))
    return j.select("transaction_id", "customer_id", "hour_of_day", "is_international",
                    "customer_txn_count_30d", "customer_avg_amount_30d", "amount_ratio_to_avg",
                    "probability", "risk_score", "risk_level")
