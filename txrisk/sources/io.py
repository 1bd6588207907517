"""Sources and sinks.

Raw transaction files are read all-string with an explicit schema, so the
validation operators still see unparseable text.  Tables are written as
Parquet (optionally partitioned, e.g. by day) or CSV with a header.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions import expressions as X

RAW_COLUMNS = ["transaction_id", "customer_id", "timestamp", "amount",
               "merchant_category", "location", "device_type", "is_anomaly"]

POLICY_SCHEMA = T.StructType([
    T.StructField("model_path", T.StringType()),
    T.StructField("low_risk_threshold", T.DoubleType()),
    T.StructField("high_risk_threshold", T.DoubleType()),
])

METRIC_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("run", T.StringType()),
])


# Texts that stand for a missing value in a text file.
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                 "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: Text files keep every blank and quote of a value.
CSV_OPTIONS = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "quote": '"', "escape": '"',
               "timestampFormat": "yyyy-MM-dd HH:mm:ss", "emptyValue": ""}


def all_string_schema(columns=RAW_COLUMNS) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def scan_transactions(spark: SparkSession, path: str, fmt: str = "csv", columns=None,
                      missing=tuple(MISSING_TEXTS), order_col: str | None = None,
                      multi_line: bool = False) -> DataFrame:
    """Read a transaction file with a header, every column as text.

    A missing path raises ``AnalysisException`` (PATH_NOT_FOUND).  For CSV the
    header decides the columns; pass ``columns`` to pin them.  Texts that stand for
    a missing value become NULL (``missing=()`` keeps them).  ``order_col`` adds the
    position of each row in the input, by which results can be put back in order.
    ``multi_line``: quoted values may hold line ends; a file is then one task, so the
    default takes every line end as the end of a row and splits files.
    """
    if fmt == "csv":
        reader = spark.read.options(**CSV_OPTIONS).option("mode", "PERMISSIVE").option("multiLine", multi_line)
        names = columns if columns is not None else reader.csv(path).columns  # header only, no inference
        df = reader.schema(all_string_schema(names)).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    texts = [F.col(c).cast("string") for c in df.columns]
    out = df.select(*[F.when(~t.isin(list(missing)), t).alias(c) if missing else t.alias(c) for c, t in zip(df.columns, texts)])
    return out.withColumn(order_col, F.monotonically_increasing_id()) if order_col else out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None,
                mode: str = "overwrite") -> str:
    """Write a table (Parquet by default, CSV with header on request)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(**CSV_OPTIONS).csv(path)
    else:
        w.format(fmt).save(path)
    return path


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        return r.options(**CSV_OPTIONS).csv(path)
    return r.format(fmt).load(path)


def risk_policy(spark: SparkSession, path: str | None = None) -> DataFrame:
    """S3: one-row threshold policy; missing or invalid keys fall back to 0.20 / 0.60.

    A missing or unreadable file gives the all-default policy.
    """
    defaults = spark.range(1).select(
        F.lit(None).cast("string").alias("model_path"),
        F.lit(None).cast("double").alias("low_risk_threshold"),
        F.lit(None).cast("double").alias("high_risk_threshold"))
    src = defaults
    if path:
        try:
            raw = spark.read.schema(POLICY_SCHEMA).option("multiLine", True).json(path)
            raw.schema  # force path resolution
            src = raw
        except Exception:  # noqa: BLE001 - unreadable policy -> defaults, as in the reference
            src = defaults
    agg = src.agg(F.first("model_path", ignorenulls=True).alias("model_path"),
                  F.first("low_risk_threshold", ignorenulls=True).alias("low_risk_threshold"),
                  F.first("high_risk_threshold", ignorenulls=True).alias("high_risk_threshold"))
    return agg.select(
        "model_path",
        F.coalesce("low_risk_threshold", F.lit(X.DEFAULT_LOW_RISK_THRESHOLD)).alias("low_risk_threshold"),
        F.coalesce("high_risk_threshold", F.lit(X.DEFAULT_HIGH_RISK_THRESHOLD)).alias("high_risk_threshold"))


# Fallback order of stored models / metrics (fixed values).
MODEL_FALLBACK = ["random_forest_tuned", "random_forest", "baseline"]


def save_metrics(df_long: DataFrame, path: str, mode: str = "append") -> str:
    """S4 (write): add a run of ``model, metric, value`` rows to the metric table.

    A run is named by the time of its writing, so that names sort as runs do; what was stored
    before stays readable, and the newest run of a model is its current set."""
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df_long.select(F.col("model").cast("string"), F.col("metric").cast("string"),
                   F.col("value").cast("double"), F.lit(run).alias("run")).write.mode(mode).parquet(path)
    return path


def current_metrics(spark: SparkSession, path: str) -> DataFrame:
    """``model, metric, value, run`` of the newest run of every model; rows stored without a run are the oldest.

    One aggregate finds the newest run (one row a model, combined before the shuffle), so the history is read, not moved."""
    m = spark.read.schema(METRIC_SCHEMA).parquet(path).withColumn("run", F.coalesce("run", F.lit("")))
    newest = m.groupBy("model").agg(F.max("run").alias("run"))
    return m.join(newest, ["model", "run"]).select("model", "metric", "value", "run")


def load_model_metrics(spark: SparkSession, path: str, model_name: str | None = None,
                       fallback=MODEL_FALLBACK) -> DataFrame:
    """S4 (lookup): current metrics of the stored model named ``model_name``; else of the model its name
    speaks of, in any case ("tuned": the tuned forest; "rf" or "random_forest": the forest; anything else: the
    baseline); else, where that is not stored, of the first stored one in the fallback order."""
    m = current_metrics(spark, path).drop("run")
    prio = F.create_map(*[x for i, n in enumerate(fallback) for x in (F.lit(n), F.lit(i))])
    name = (model_name or "").lower()
    meant = ("random_forest_tuned" if "tuned" in name else
             "random_forest" if "rf" in name or "random_forest" in name else "baseline" if name else "")
    rank = (F.when(F.col("model") == (model_name or ""), F.lit(0)).when(F.col("model") == meant, F.lit(1))
             .otherwise(F.lit(2) + F.coalesce(prio[F.col("model")], F.lit(len(fallback)))))
    best = m.select(F.min(rank)).scalar()
    return m.where(rank == best)


def stored_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The table at ``path``, or None if there is none yet; any other failure to read it is raised."""
    try:
        df = read_table(spark, path, fmt)
        df.schema  # resolves the path
        return df
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def scan_history(spark: SparkSession, path: str | None, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Optional history table; absent -> empty frame (cold start)."""
    stored = stored_table(spark, path, fmt) if path else None
    return stored if stored is not None else spark.createDataFrame([], schema)
