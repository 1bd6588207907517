"""Registered queries: model data prep (M), models (T, E1, R1), sources and sinks (S), F7.

Queries that fit a model have no SQL oracle (rows-only check); their exact
counterparts (split quotas, scaler, encoder, best-model pick) do.
Fits use the library defaults, which are the reference's (100 trees, depth 30
probes are in bench.py.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from txrisk.functions import expressions as X
from txrisk.operators import evaluation as EV
from txrisk.operators import mlprep as MP
from txrisk.operators import models as MD
from txrisk.operators import risk as RK
from txrisk.plans import queries as Q
from txrisk.plans import queries_eval as QE
from txrisk.plans.registry import register
from txrisk.plans.scoring import history_context_features
from txrisk.session import persist_shared, scratch_path
from txrisk.sources import adapter as A
from txrisk.sources import io as IO

ML_KEYS = ["transaction_id", "customer_id", "ts"]
NUMERIC = MP.ENGINEERED_NUMERIC
CATEGORICAL = MP.ENGINEERED_CATEGORICAL

ML_SQL = Q._velocity_sql(A.TRANSACTIONS_SQL, """, ts, amount,
       CAST(hour(ts) AS INTEGER) AS hour_of_day,
       CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
       merchant_category, location, device_type,
       CAST(CASE WHEN isodow(ts) IN (6, 7) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
       CAST(CASE WHEN suffix(lower(location), 'us') THEN 0 ELSE 1 END AS INTEGER) AS is_international,
       is_anomaly""")

SPLIT_SQL = f"""
f AS ({ML_SQL}),
q0 AS (SELECT is_anomaly, count(*) AS n_class FROM f GROUP BY is_anomaly),
q1 AS (SELECT *, sum(n_class) OVER () AS n_all FROM q0),
q2 AS (SELECT *, n_all - (n_all + 4) // 5 AS ntrain FROM q1),
q3 AS (SELECT *, (n_class * ntrain) // n_all AS fl, (n_class * ntrain) % n_all AS rem FROM q2),
q4 AS (SELECT *, ntrain - sum(fl) OVER () AS lft, row_number() OVER (ORDER BY rem DESC, is_anomaly) AS r FROM q3),
q AS (SELECT is_anomaly, n_class - (fl + CASE WHEN r <= lft THEN 1 ELSE 0 END) AS test_quota FROM q4),
s AS (SELECT f.*, row_number() OVER (PARTITION BY is_anomaly ORDER BY md5(transaction_id || ':42'), transaction_id) AS rk
      FROM f),
sp AS (SELECT s.*, CASE WHEN rk <= test_quota THEN 'test' ELSE 'train' END AS split
       FROM s JOIN q ON s.is_anomaly = q.is_anomaly),
tr AS (SELECT * FROM sp WHERE split = 'train')"""


def ml_table(spark, sf):
    return MP.select_features(Q.features_of(spark, sf), keys=ML_KEYS)


def split_table(spark, sf):
    return MP.stratified_split(ml_table(spark, sf))


# ------------------------------------------------------------ data prep (M)

@register("select_features", sql=f"""
SELECT transaction_id, customer_id, CAST(ts AS VARCHAR) AS ts, {", ".join(NUMERIC + CATEGORICAL)}, is_anomaly
FROM ({ML_SQL})""")
def q_select_features(spark, sf):
    return ml_table(spark, sf).withColumn("ts", F.col("ts").cast("string"))


@register("stratified_split", sql=f"WITH {SPLIT_SQL} SELECT transaction_id, is_anomaly, split FROM sp",
          headline=True)
def q_split(spark, sf):
    return split_table(spark, sf).select("transaction_id", "is_anomaly", "split")


def _scale_sql():
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC)
    cols = ", ".join(f"round_even(({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END, 6) AS {c}"
                     for c in NUMERIC)
    return f"WITH {SPLIT_SQL}, st AS (SELECT {stats} FROM tr) SELECT transaction_id, split, {cols} FROM sp, st"


@register("standard_scale", sql=_scale_sql())
def q_scale(spark, sf):
    sp = split_table(spark, sf)
    stats = MP.fit_scaler(sp.where(F.col("split") == "train"))
    z = MP.standard_scale(sp, stats)
    return z.select("transaction_id", "split", *[X.round_half_even(c, 6).alias(c) for c in NUMERIC])


def _onehot_sql():
    parts = [f"SELECT transaction_id, '{c}_' || CAST({c} AS VARCHAR) AS feature FROM sp "
             f"WHERE CAST({c} AS VARCHAR) IN (SELECT CAST({c} AS VARCHAR) FROM tr)" for c in CATEGORICAL]
    return f"WITH {SPLIT_SQL} " + " UNION ALL ".join(parts)


@register("one_hot_encode", sql=_onehot_sql())
def q_one_hot(spark, sf):
    sp = split_table(spark, sf)
    levels = MP.level_table(sp.where(F.col("split") == "train"))
    ones = MP.one_hot_sparse(sp, levels, keep=["transaction_id"]).select("transaction_id", F.explode("slots").alias("slot"))
    return ones.join(levels, "slot").select("transaction_id", F.concat("column", F.lit("_"), "value").alias("feature"))


@register("split_report", sql=f"""
WITH {SPLIT_SQL},
w AS (SELECT 6 + {" + ".join(f"count(DISTINCT {c})" for c in CATEGORICAL)} AS n_features FROM tr)
SELECT split, count(*) AS n_rows, avg(is_anomaly) AS anomaly_rate, CAST(max(n_features) AS INTEGER) AS n_features
FROM sp, w GROUP BY split""")
def q_split_report(spark, sf):
    sp = split_table(spark, sf)
    width = len(NUMERIC) + MP.level_table(sp.where(F.col("split") == "train")).count()
    return MP.split_report(sp, n_features=width)


@register("test_metadata", sql=f"""
WITH {SPLIT_SQL} SELECT transaction_id, customer_id, CAST(ts AS VARCHAR) AS ts, is_anomaly FROM sp
WHERE split = 'test'""")
def q_test_metadata(spark, sf):
    return MP.test_metadata(split_table(spark, sf), keys=ML_KEYS).withColumn("ts", F.col("ts").cast("string"))


# --------------------------------------------------------------- models (T)

def encoded(spark, sf):
    sp = persist_shared(split_table(spark, sf))
    pipe = MP.feature_pipeline(sp.where(F.col("split") == "train"))
    return MP.apply_pipeline(pipe, sp), pipe


@register("feature_pipeline")
def q_feature_pipeline(spark, sf):
    enc, _ = encoded(spark, sf)
    return enc.select("transaction_id", "split", F.size(vector_to_array("features")).alias("n_features"))


def fitted_logistic(spark, sf):
    enc, pipe = encoded(spark, sf)
    train = enc.where(F.col("split") == "train")
    return MD.train_logistic(train), enc, pipe


@register("train_logistic")
def q_train_logistic(spark, sf):
    model, enc, _ = fitted_logistic(spark, sf)
    test = MD.score(model, enc.where(F.col("split") == "test").select("transaction_id", "features", "is_anomaly"))
    return EV.classification_metrics(test, label_col="is_anomaly")


@register("score_test")
def q_score_test(spark, sf):
    model, enc, _ = fitted_logistic(spark, sf)
    test = enc.where(F.col("split") == "test").select("transaction_id", "features", "is_anomaly")
    return MD.score(model, test).select("transaction_id", F.col("is_anomaly").alias("actual"),
                                        F.col("prediction").alias("predicted"), "probability")


@register("train_forest")
def q_train_forest(spark, sf, **settings):
    enc, _ = encoded(spark, sf)
    model = MD.train_forest(enc.where(F.col("split") == "train"), **settings)
    test = MD.score(model, enc.where(F.col("split") == "test").select("transaction_id", "features", "is_anomaly"))
    return EV.classification_metrics(test, label_col="is_anomaly")


@register("forest_repeatable", sql="SELECT CAST(0 AS BIGINT) AS differing_predictions")
def q_forest_repeatable(spark, sf):
    """Predictions that differ between two forests fitted to the same rows in another partitioning: none."""
    enc, _ = encoded(spark, sf)
    train = enc.where(F.col("split") == "train").select("transaction_id", "features", "is_anomaly")
    test = enc.where(F.col("split") == "test").select("transaction_id", "features", "is_anomaly")
    fits = [MD.train_forest(t) for t in (train, train.repartition(3, F.rand(7)))]
    a, b = (MD.score(m, test).select("transaction_id", F.col("probability").alias(n)) for m, n in zip(fits, "ab"))
    return a.join(b, "transaction_id").agg(F.count_if(F.col("a") != F.col("b")).cast("long").alias("differing_predictions"))


def search(spark, sf, space=MD.SEARCH_SPACE, n_iter=MD.N_ITER):
    enc, _ = encoded(spark, sf)
    train = MD.stratified_folds(enc.where(F.col("split") == "train").select("transaction_id", "features",
                                                                          "is_anomaly"))
    cands = MD.sample_candidates(space, n_iter)
    return MD.tune_forest(train, cands)[0], enc


@register("tune_forest")
def q_tune_forest(spark, sf, **settings):
    found, enc = search(spark, sf, **settings)
    test = MD.score(found.bestModel, enc.where(F.col("split") == "test").select("transaction_id", "features",
                                                                              "is_anomaly"))
    return EV.classification_metrics(test, label_col="is_anomaly")


@register("cv_results")
def q_cv_results(spark, sf):
    return MD.cv_results(spark, search(spark, sf)[0])


MODEL_ORDER = ["amount_only", "amount_geo", "amount_geo_coarse"]


@register("select_best_model", sql=f"""
WITH {QE.COMPARE_SQL},
o AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {i})" for i, m in enumerate(MODEL_ORDER))}) v(model, position))
SELECT cmp.*, position FROM cmp JOIN o ON cmp.model = o.model ORDER BY f1_score DESC, position LIMIT 1""")
def q_best_model(spark, sf):
    return MD.select_best_model(QE.compare(spark, sf), MODEL_ORDER)


@register("feature_drivers")
def q_feature_drivers(spark, sf):
    enc, pipe = encoded(spark, sf)
    train = enc.where(F.col("split") == "train")
    model = MD.train_forest(train)
    return MD.feature_drivers(spark, model, MP.pipeline_feature_names(pipe), k=10)


def _scratch(spark, name):
    return scratch_path(spark, f"txrisk-{name}-{uuid.uuid4().hex[:12]}")


@register("model_store")
def q_model_store(spark, sf):
    model, enc, pipe = fitted_logistic(spark, sf)
    pdir = MD.save_model(pipe, _scratch(spark, "pipeline"))
    mdir = MD.save_model(model, _scratch(spark, "model"))
    from pyspark.ml.classification import LogisticRegressionModel
    pipe2, model2 = MD.load_pipeline(pdir), LogisticRegressionModel.load(mdir)
    sp = split_table(spark, sf).where(F.col("split") == "test")
    return MD.score(model2, MP.apply_pipeline(pipe2, sp).select("transaction_id", "features", "is_anomaly"))


@register("score_batch")
def q_score_batch(spark, sf):
    """R1 on the test split as the incoming batch, with the train split as history; rows that fail validation (at sf0.1
    amounts of zero) are returned without a score instead of stopping the batch."""
    model, enc, pipe = fitted_logistic(spark, sf)
    t = A.transactions(spark, sf)
    sp = split_table(spark, sf).select("transaction_id", "split")
    tagged = t.join(sp, "transaction_id")
    batch = tagged.where(F.col("split") == "test").drop("split")
    history = tagged.where(F.col("split") == "train").drop("split")
    return MD.score_batch(batch, pipe, model, history=history, ts_col="ts", keep_invalid=True)


# ------------------------------------------------------- sources / sinks (S)

@register("scan_transactions", sql=A.RAW_TRANSACTIONS_SQL)
def q_scan(spark, sf):
    path = _scratch(spark, "raw-csv")
    raw = A.raw_transactions(spark, sf)
    IO.write_table(raw, path, fmt="csv")
    return IO.scan_transactions(spark, path, columns=raw.columns)


@register("write_table", sql=f"""
SELECT transaction_id, customer_id, CAST(ts AS VARCHAR) AS ts, amount, merchant_category, location, device_type,
       is_anomaly, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM ({A.TRANSACTIONS_SQL})""")
def q_write_table(spark, sf):
    path = _scratch(spark, "txn-parquet")
    t = A.transactions(spark, sf).withColumn("day", F.to_date("ts").cast("string"))
    IO.write_table(t, path, partition_by=["day"])
    back = IO.read_table(spark, path)
    return back.select(*[c for c in t.columns]).withColumn("ts", F.col("ts").cast("string")) \
        .withColumn("day", F.col("day").cast("string"))


@register("risk_policy", sql=f"""
WITH s AS (SELECT CASE WHEN probability < 0.25 THEN 'Low Risk' WHEN probability < 0.6 THEN 'Medium Risk'
                       ELSE 'High Risk' END AS risk_level FROM ({A.SCORED_SQL}) WHERE model = 'amount_geo'),
a AS (SELECT count(*) AS total_predictions,
             count(*) FILTER (WHERE risk_level = 'High Risk') AS high_risk_cases,
             count(*) FILTER (WHERE risk_level = 'Medium Risk') AS medium_risk_cases,
             count(*) FILTER (WHERE risk_level = 'Low Risk') AS low_risk_cases FROM s)
SELECT total_predictions, high_risk_cases, medium_risk_cases, low_risk_cases,
       round_even(high_risk_cases * 100.0 / total_predictions, 2) AS percentage_high_risk,
       round_even(medium_risk_cases * 100.0 / total_predictions, 2) AS percentage_medium_risk,
       round_even(low_risk_cases * 100.0 / total_predictions, 2) AS percentage_low_risk,
       CAST(0.25 AS DOUBLE) AS low_risk_threshold, CAST(0.6 AS DOUBLE) AS high_risk_threshold FROM a""")
def q_risk_policy(spark, sf):
    """A policy file that sets only the low threshold: the high one falls back to 0.60."""
    path = _scratch(spark, "policy")
    spark.range(1).select(F.lit(0.25).alias("low_risk_threshold")).coalesce(1).write.mode("overwrite").json(path)
    policy = IO.risk_policy(spark, path)
    s = QE.one_model(spark, sf)
    return RK.risk_summary(RK.risk_level(s, policy=policy), policy=policy)


@register("metric_store", sql=f"""
WITH {QE.COMPARE_SQL}
SELECT model, 'accuracy' AS metric, accuracy AS value FROM cmp WHERE model = 'amount_geo' UNION ALL
SELECT model, 'precision', precision FROM cmp WHERE model = 'amount_geo' UNION ALL
SELECT model, 'recall', recall FROM cmp WHERE model = 'amount_geo' UNION ALL
SELECT model, 'f1_score', f1_score FROM cmp WHERE model = 'amount_geo' UNION ALL
SELECT model, 'roc_auc', roc_auc FROM cmp WHERE model = 'amount_geo'""")
def q_metric_store(spark, sf):
    path = _scratch(spark, "metrics")
    cmp = QE.compare(spark, sf)
    long = cmp.unpivot(["model"], ["accuracy", "precision", "recall", "f1_score", "roc_auc"], "metric", "value")
    IO.save_metrics(long, path, mode="overwrite")
    return IO.load_model_metrics(spark, path, model_name="amount_geo")


# ---------------------------------------------------- history context

NEW_FROM = "2024-01-21 00:00:00"
F7_EXTRA = """, lower(regexp_replace(location, '^\\s+|\\s+$', '', 'g')) AS location,
       CAST(CASE WHEN suffix(lower(location), 'us') THEN 0 ELSE 1 END AS INTEGER) AS is_international"""


def _f7_sql(with_history: bool) -> str:
    new_only = f" WHERE ts >= TIMESTAMP '{NEW_FROM}'" if with_history else ""
    return f"""
SELECT transaction_id, customer_id, location, is_international, customer_txn_count_30d,
       customer_avg_amount_30d, amount_ratio_to_avg
FROM ({Q._velocity_sql(A.TRANSACTIONS_SQL, F7_EXTRA + ", ts")}){new_only}"""


F7_COLS = ["transaction_id", "customer_id", "location", "is_international", "customer_txn_count_30d",
           "customer_avg_amount_30d", "amount_ratio_to_avg"]


@register("history_context_features", sql=_f7_sql(True))
def q_history_context(spark, sf):
    """New batch = transactions from the last ten days; history = the earlier ones, read back from a table."""
    t = A.transactions(spark, sf)
    cut = F.lit(NEW_FROM).cast("timestamp")
    path = _scratch(spark, "history")
    IO.write_table(t.where(F.col("ts") < cut).withColumn("day", F.to_date("ts").cast("string")), path,
                   partition_by=["day"])
    history = IO.scan_history(spark, path, t.schema)
    return history_context_features(t.where(F.col("ts") >= cut), history, ts_col="ts").select(*F7_COLS)


@register("scan_history", sql=_f7_sql(False))
def q_scan_history(spark, sf):
    """Cold start: the history path does not exist, so the batch, the whole table, is its own context."""
    t = A.transactions(spark, sf)
    history = IO.scan_history(spark, _scratch(spark, "absent-history"), t.schema)
    return history_context_features(t, history, ts_col="ts").select(*F7_COLS)
