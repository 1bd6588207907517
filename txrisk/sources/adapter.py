"""Views of the driver's test tables in the transaction data model.

The test tables hold no card transactions, so these builders map ``events``
(and ``orders``) onto the transaction schema.  Every builder has a twin SQL
text (``*_SQL``) that DuckDB runs in the oracle; both must give the same rows.

Join sizes: ``nation`` (25 rows) and ``region`` (5 rows) are fixed-size TPC-H
dimensions and are broadcast explicitly; ``customer`` grows with the scale
factor, so the planner (statistics + AQE) chooses its join strategy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the test-data mapping (FIXTURES.md section 2).
DEVICE_BY_MOD4 = ["mobile", "web", "pos", "atm"]
DOMESTIC_REGION = "AMERICA"
DOMESTIC_CODE = "US"
ANOMALY_AMOUNT = 200.0
ODD_HOUR_AMOUNT = 120.0
ODD_HOURS = (2, 4)
# Defect rules of raw_transactions, by transaction number k.
DEFECT_MISSING_CUSTOMER = 113
DEFECT_BAD_TIMESTAMP = 127
DEFECT_MISSING_AMOUNT = 97
DEFECT_TEXT_AMOUNT = 89
DEFECT_NEGATIVE_AMOUNT = 83
DEFECT_MISSING_CATEGORY = 79
DEFECT_PADDED_CATEGORY = 73
DEFECT_DUPLICATE = 101


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _device(props: Column) -> Column:
    m = F.regexp_extract(props, r"([0-9]+)", 1).try_cast("int") % 4
    return (F.when(m == 0, DEVICE_BY_MOD4[0]).when(m == 1, DEVICE_BY_MOD4[1])
            .when(m == 2, DEVICE_BY_MOD4[2]).otherwise(DEVICE_BY_MOD4[3]))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` joined to customer -> nation -> region, in the transaction schema."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    na = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    re_ = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = na.join(F.broadcast(re_), na.n_regionkey == re_.r_regionkey)
    j = (ev.join(cu, ev.user_id == cu.c_custkey)
           .join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey")))
    ts = F.col("ts").cast("timestamp")
    region_code = F.when(F.col("r_name") == DOMESTIC_REGION, F.lit(DOMESTIC_CODE)).otherwise(F.col("r_name"))
    is_anom = ((F.col("value") >= ANOMALY_AMOUNT)
               | ((F.col("r_name") != DOMESTIC_REGION)
                  & F.hour(ts).between(*ODD_HOURS)
                  & (F.col("value") >= ODD_HOUR_AMOUNT)))
    return j.select(
        F.format_string("TXN%08d", F.col("event_id")).alias("transaction_id"),
        F.format_string("CUST%06d", F.col("user_id")).alias("customer_id"),
        ts.alias("ts"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("merchant_category"),
        F.concat_ws(", ", F.col("n_name"), region_code).alias("location"),
        _device(F.col("props")).alias("device_type"),
        is_anom.cast("int").alias("is_anomaly"),
    )


TRANSACTIONS_SQL = f"""
SELECT printf('TXN%08d', event_id) AS transaction_id,
       printf('CUST%06d', user_id) AS customer_id,
       CAST(ts AS TIMESTAMP) AS ts,
       value AS amount,
       event_type AS merchant_category,
       n_name || ', ' || CASE r_name WHEN '{DOMESTIC_REGION}' THEN '{DOMESTIC_CODE}' ELSE r_name END AS location,
       CASE TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 4
            WHEN 0 THEN 'mobile' WHEN 1 THEN 'web' WHEN 2 THEN 'pos' ELSE 'atm' END AS device_type,
       CAST(CASE WHEN value >= {ANOMALY_AMOUNT}
              OR (r_name <> '{DOMESTIC_REGION}' AND hour(ts) BETWEEN {ODD_HOURS[0]} AND {ODD_HOURS[1]}
                  AND value >= {ODD_HOUR_AMOUNT})
            THEN 1 ELSE 0 END AS INTEGER) AS is_anomaly
FROM events JOIN customer ON user_id = c_custkey
            JOIN nation ON c_nationkey = n_nationkey
            JOIN region ON n_regionkey = r_regionkey
"""


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string transactions with injected defects (FIXTURES.md 2.2)."""
    t = transactions(spark, sf_dir)
    k = F.regexp_extract("transaction_id", r"([0-9]+)", 1).cast("long")

    def hit(m):
        return (k % m) == 0

    amount_txt = F.col("amount").cast("string")
    raw = t.select(
        F.col("transaction_id"),
        F.when(hit(DEFECT_MISSING_CUSTOMER), F.lit(None).cast("string")).otherwise(F.col("customer_id")).alias("customer_id"),
        F.when(hit(DEFECT_BAD_TIMESTAMP), F.lit("not a time"))
         .otherwise(F.substring(F.col("ts").cast("string"), 1, 19)).alias("ts"),
        F.when(hit(DEFECT_MISSING_AMOUNT), F.lit(None).cast("string"))
         .when(hit(DEFECT_TEXT_AMOUNT), F.lit("one hundred"))
         .when(hit(DEFECT_NEGATIVE_AMOUNT), F.lit("-5.0"))
         .otherwise(amount_txt).alias("amount"),
        F.when(hit(DEFECT_MISSING_CATEGORY), F.lit(None).cast("string"))
         .when(hit(DEFECT_PADDED_CATEGORY), F.concat(F.lit("  "), F.upper("merchant_category"), F.lit(" ")))
         .otherwise(F.col("merchant_category")).alias("merchant_category"),
        F.col("location"),
        F.col("device_type"),
        F.col("is_anomaly").cast("string").alias("is_anomaly"),
    )
    # Exact duplicates are generated in the same pass (no second scan of the source).
    copies = F.when(hit(DEFECT_DUPLICATE), F.lit(2)).otherwise(F.lit(1))
    return raw.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


RAW_TRANSACTIONS_SQL = f"""
WITH t AS ({TRANSACTIONS_SQL}),
r AS (
SELECT transaction_id,
       CASE WHEN CAST(substr(transaction_id, 4) AS BIGINT) % {DEFECT_MISSING_CUSTOMER} = 0 THEN NULL ELSE customer_id END AS customer_id,
       CASE WHEN CAST(substr(transaction_id, 4) AS BIGINT) % {DEFECT_BAD_TIMESTAMP} = 0 THEN 'not a time'
            ELSE substr(CAST(ts AS VARCHAR), 1, 19) END AS ts,
       CASE WHEN CAST(substr(transaction_id, 4) AS BIGINT) % {DEFECT_MISSING_AMOUNT} = 0 THEN NULL
            WHEN CAST(substr(transaction_id, 4) AS BIGINT) % {DEFECT_TEXT_AMOUNT} = 0 THEN 'one hundred'
            WHEN CAST(substr(transaction_id, 4) AS BIGINT) % {DEFECT_NEGATIVE_AMOUNT} = 0 THEN '-5.0'
            ELSE CAST(amount AS VARCHAR) END AS amount,
       CASE WHEN CAST(substr(transaction_id, 4) AS BIGINT) % {DEFECT_MISSING_CATEGORY} = 0 THEN NULL
            WHEN CAST(substr(transaction_id, 4) AS BIGINT) % {DEFECT_PADDED_CATEGORY} = 0 THEN '  ' || upper(merchant_category) || ' '
            ELSE merchant_category END AS merchant_category,
       location, device_type, CAST(is_anomaly AS VARCHAR) AS is_anomaly
FROM t)
SELECT * FROM r
UNION ALL
SELECT * FROM r WHERE CAST(substr(transaction_id, 4) AS BIGINT) % {DEFECT_DUPLICATE} = 0
"""


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as transactions: years of range and repeated (customer, day) ties."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.format_string("ORD%010d", F.col("o_orderkey")).alias("transaction_id"),
        F.format_string("CUST%06d", F.col("o_custkey")).alias("customer_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_totalprice").alias("amount"),
    )


ORDER_TRANSACTIONS_SQL = """
SELECT printf('ORD%010d', o_orderkey) AS transaction_id,
       printf('CUST%06d', o_custkey) AS customer_id,
       CAST(o_orderdate AS TIMESTAMP) AS ts,
       o_totalprice AS amount
FROM orders
"""


# Closed-form anomaly scores used to exercise the evaluation and risk operators
# without a fitted model.  floor() of an exactly representable double keeps the
# probability bit-identical between Spark and the SQL oracle, and the 3-decimal
# grid makes score ties common.
SCORE_MODELS = ["amount_only", "amount_geo", "amount_geo_coarse"]


def _score_exprs(amount: Column, intl_odd: Column) -> dict:
    base = F.floor(amount * 2)
    geo = base + F.when(intl_odd, F.lit(300)).otherwise(F.lit(0))
    p_amount = F.least(base, F.lit(999)) / F.lit(1000.0)
    p_geo = F.least(geo, F.lit(999)) / F.lit(1000.0)
    p_coarse = F.floor(F.least(geo, F.lit(999)) / F.lit(100)) / F.lit(10.0)
    return {"amount_only": p_amount, "amount_geo": p_geo, "amount_geo_coarse": p_coarse}


def scored_transactions(spark: SparkSession, sf_dir: str, models=None) -> DataFrame:
    """Transactions with ``model, label, probability, prediction`` (one row per model)."""
    t = transactions(spark, sf_dir)
    intl_odd = (~F.lower("location").endswith("us")) & F.hour("ts").between(*ODD_HOURS)
    exprs = _score_exprs(F.col("amount"), intl_odd)
    models = models or SCORE_MODELS
    arr = F.array(*[F.struct(F.lit(m).alias("model"), exprs[m].alias("probability")) for m in models])
    out = t.select("transaction_id", "customer_id", "ts", "amount", "location",
                   F.col("is_anomaly").alias("label"), F.explode(arr).alias("s"))
    return out.select("transaction_id", "customer_id", "ts", "amount", "location", "label",
                      F.col("s.model").alias("model"), F.col("s.probability").alias("probability"),
                      (F.col("s.probability") >= 0.5).cast("int").alias("prediction"))


SCORED_SQL = f"""
WITH t AS ({TRANSACTIONS_SQL}),
b AS (SELECT *, floor(amount * 2) AS base,
             floor(amount * 2) + CASE WHEN NOT suffix(lower(location), 'us') AND hour(ts) BETWEEN 2 AND 4
                                      THEN 300 ELSE 0 END AS geo FROM t),
s AS (
  SELECT transaction_id, customer_id, ts, amount, location, is_anomaly AS label, 'amount_only' AS model,
         least(base, 999) / 1000.0 AS probability FROM b
  UNION ALL
  SELECT transaction_id, customer_id, ts, amount, location, is_anomaly, 'amount_geo',
         least(geo, 999) / 1000.0 FROM b
  UNION ALL
  SELECT transaction_id, customer_id, ts, amount, location, is_anomaly, 'amount_geo_coarse',
         floor(least(geo, 999) / 100) / 10.0 FROM b)
SELECT *, CAST(probability >= 0.5 AS INTEGER) AS prediction FROM s
"""


def closed_form_score(df: DataFrame, model: str = "amount_geo", ts_col: str = "ts",
                      amount_col: str = "amount", location_col: str = "location") -> DataFrame:
    """Attach ``probability`` and ``prediction`` of one closed-form model to any transaction frame."""
    intl_odd = (~F.lower(F.col(location_col)).endswith("us")) & F.hour(F.col(ts_col)).between(*ODD_HOURS)
    p = _score_exprs(F.col(amount_col), intl_odd)[model]
    return df.withColumn("probability", p).withColumn("prediction", (p >= 0.5).cast("int"))
