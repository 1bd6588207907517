"""Registered queries: evaluation aggregates (E) and risk reporting (R).

The scored table carries three closed-form models, so every aggregate runs
grouped by ``model`` — the multi-model form of the single-run reference
answer (one plan, one pass).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from txrisk.functions import expressions as X

from txrisk.operators import evaluation as EV
from txrisk.operators import risk as RK
from txrisk.plans.registry import register
from txrisk.sources import adapter as A

S_SQL = A.SCORED_SQL
BY = ["model"]


def scored(spark, sf):
    return A.scored_transactions(spark, sf)


def one_model(spark, sf, model="amount_geo"):
    return scored(spark, sf).where(F.col("model") == model)


def _counts_sql(src: str = "s") -> str:
    """CTEs ``{src}`` (scored rows), ``d`` (per model and score) and ``c`` (running counts)."""
    return f"""
{src} AS ({S_SQL}),
d AS (SELECT model, probability AS score, count(*) FILTER (WHERE label = 1) AS pos,
             count(*) FILTER (WHERE label <> 1) AS neg FROM {src} GROUP BY model, probability),
c AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_pos_ge,
                sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_neg_ge,
                sum(pos) OVER (PARTITION BY model) AS n_pos, sum(neg) OVER (PARTITION BY model) AS n_neg FROM d)"""


COUNTS_SQL = _counts_sql()

CM_SQL = f"""
s AS ({S_SQL}),
m AS (SELECT model, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
             count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
             count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM s GROUP BY model)"""


def _ratio(num, den):
    return f"CASE WHEN ({den}) <> 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0 END"


METRICS_SQL = f"""tn, fp, fn, tp, {_ratio('tp + tn', 'tp + tn + fp + fn')} AS accuracy,
       {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall,
       {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1"""

AUC_SQL = """CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN
         CAST(sum(pos * ((n_neg - cum_neg_ge) + 0.5 * neg)) AS DOUBLE)
         / (CAST(max(n_pos) AS DOUBLE) * CAST(max(n_neg) AS DOUBLE)) END"""


@register("confusion_matrix", sql=f"""
WITH {CM_SQL}
SELECT model, 0 AS actual, 0 AS predicted, tn AS count FROM m UNION ALL
SELECT model, 0, 1, fp FROM m UNION ALL SELECT model, 1, 0, fn FROM m UNION ALL SELECT model, 1, 1, tp FROM m""")
def q_confusion(spark, sf):
    return EV.confusion_matrix(scored(spark, sf), by=BY)


@register("classification_metrics", sql=f"WITH {CM_SQL} SELECT model, {METRICS_SQL} FROM m", headline=True)
def q_metrics(spark, sf):
    return EV.classification_metrics(scored(spark, sf), by=BY)


@register("roc_auc", sql=f"WITH {COUNTS_SQL} SELECT model, {AUC_SQL} AS roc_auc FROM c GROUP BY model",
          headline=True)
def q_auc(spark, sf):
    return EV.roc_auc(scored(spark, sf), by=BY)


@register("classification_report", sql=f"""
WITH {CM_SQL},
k AS (SELECT model, tp, fp, fn, tn, tp + fp + fn + tn AS n,
             {_ratio('tp', 'tp + fp')} AS p1, {_ratio('tp', 'tp + fn')} AS r1, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1,
             {_ratio('tn', 'tn + fn')} AS p0, {_ratio('tn', 'tn + fp')} AS r0, {_ratio('2 * tn', '2 * tn + fn + fp')} AS f0,
             tp + fn AS s1, tn + fp AS s0, {_ratio('tp + tn', 'tp + fp + fn + tn')} AS acc FROM m)
SELECT model, '0' AS class_label, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM k UNION ALL
SELECT model, '1', p1, r1, f1, s1 FROM k UNION ALL
SELECT model, 'accuracy', acc, acc, acc, n FROM k UNION ALL
SELECT model, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM k UNION ALL
SELECT model, 'weighted avg', {_ratio('p0 * s0 + p1 * s1', 'n')}, {_ratio('r0 * s0 + r1 * s1', 'n')},
       {_ratio('f0 * s0 + f1 * s1', 'n')}, n FROM k""")
def q_report(spark, sf):
    return EV.classification_report(scored(spark, sf), by=BY)


@register("roc_curve", sql=f"""
WITH {COUNTS_SQL},
c2 AS (SELECT *, lag(cum_neg_ge) OVER w AS pf, lead(cum_neg_ge) OVER w AS nf,
              lag(cum_pos_ge) OVER w AS pt, lead(cum_pos_ge) OVER w AS nt
       FROM c WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
k AS (SELECT * FROM c2 WHERE pf IS NULL OR nf IS NULL OR nf - 2 * cum_neg_ge + pf <> 0
                             OR nt - 2 * cum_pos_ge + pt <> 0),
a AS (SELECT model, score AS threshold, cum_neg_ge AS fps, cum_pos_ge AS tps, n_pos, n_neg FROM k
      UNION ALL
      SELECT model, CAST(NULL AS DOUBLE), 0, 0, max(n_pos), max(n_neg) FROM c GROUP BY model)
SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY threshold DESC NULLS FIRST) - 1 AS INTEGER) AS point,
       threshold, {_ratio('fps', 'n_neg')} AS fpr, {_ratio('tps', 'n_pos')} AS tpr
FROM a""")
def q_roc_curve(spark, sf):
    return EV.roc_curve(scored(spark, sf), by=BY)


@register("pr_curve", sql=f"""
WITH {COUNTS_SQL}
SELECT model, score AS threshold, {_ratio('cum_pos_ge', 'cum_pos_ge + cum_neg_ge')} AS precision,
       CASE WHEN n_pos = 0 THEN 1.0 ELSE CAST(cum_pos_ge AS DOUBLE) / CAST(n_pos AS DOUBLE) END AS recall FROM c
UNION ALL
SELECT DISTINCT model, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM c""")
def q_pr_curve(spark, sf):
    return EV.pr_curve(scored(spark, sf), by=BY)


@register("average_precision", sql=f"""
WITH {COUNTS_SQL}
SELECT model, round_even(CASE WHEN max(n_pos) > 0 THEN
          sum(pos * (CAST(cum_pos_ge AS DOUBLE) / CAST(cum_pos_ge + cum_neg_ge AS DOUBLE))) / max(n_pos)
        ELSE 0.0 END, 9) AS average_precision
FROM c GROUP BY model""")
def q_ap(spark, sf):
    return EV.average_precision(scored(spark, sf), by=BY, digits=9)


COMPARE_SQL = f"""
{CM_SQL},
mm AS (SELECT model, {METRICS_SQL} FROM m),
{_counts_sql("s2")},
au AS (SELECT model, {AUC_SQL} AS roc_auc FROM c GROUP BY model),
cmp AS (SELECT mm.model, accuracy, precision, recall, f1 AS f1_score, roc_auc FROM mm JOIN au ON mm.model = au.model)"""


def compare(spark, sf):
    return EV.compare_models(scored(spark, sf))


@register("compare_models", sql=f"WITH {COMPARE_SQL} SELECT * FROM cmp", headline=True)
def q_compare(spark, sf):
    return compare(spark, sf)


@register("metric_improvement", sql=f"""
WITH {COMPARE_SQL},
l AS (SELECT model, 'f1_score' AS metric, f1_score AS value FROM cmp UNION ALL
      SELECT model, 'recall', recall FROM cmp),
p AS (SELECT metric, max(value) FILTER (WHERE model = 'amount_only') AS base,
             max(value) FILTER (WHERE model = 'amount_geo') AS tuned
      FROM l WHERE model IN ('amount_only', 'amount_geo') GROUP BY metric)
SELECT metric, base, tuned, CASE WHEN base <> 0 THEN (tuned - base) / base ELSE 0.0 END AS improvement FROM p""")
def q_improvement(spark, sf):
    return EV.metric_improvement(compare(spark, sf), "amount_only", "amount_geo")


@register("metrics_long", sql=f"""
WITH {COMPARE_SQL}
SELECT model, 'Accuracy' AS metric, accuracy AS score FROM cmp UNION ALL
SELECT model, 'Precision', precision FROM cmp UNION ALL
SELECT model, 'Recall', recall FROM cmp UNION ALL
SELECT model, 'F1-Score', f1_score FROM cmp""")
def q_metrics_long(spark, sf):
    return EV.metrics_long(compare(spark, sf))


@register("run_level_metrics", sql=f"""
WITH s AS (SELECT * FROM ({S_SQL}) WHERE model = 'amount_geo'),
m AS (SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
             count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
             count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
             count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM s
      WHERE (SELECT count(DISTINCT label) FROM s) > 1)
SELECT {METRICS_SQL} FROM m WHERE tn + fp + fn + tp > 0""")
def q_run_level(spark, sf):
    batch = one_model(spark, sf).withColumnRenamed("label", "is_anomaly")
    return EV.run_level_metrics(batch)


# ------------------------------------------------------------------ risk (R)

LEVEL_SQL = """CASE WHEN probability < 0.2 THEN 'Low Risk' WHEN probability < 0.6 THEN 'Medium Risk'
                    ELSE 'High Risk' END"""
TIERED_SQL = f"""
s AS ({S_SQL}),
r AS (SELECT *, round_even(probability * 100, 2) AS risk_score, {LEVEL_SQL} AS risk_level FROM s)"""


def tiered(spark, sf):
    return RK.risk_level(RK.risk_score(scored(spark, sf)))


@register("prediction_table", sql=f"""
WITH {TIERED_SQL}
SELECT transaction_id AS "Transaction ID", customer_id AS "Customer ID", CAST(ts AS VARCHAR) AS "Timestamp",
       CAST(prediction AS INTEGER) AS prediction, probability AS probability_score, risk_score, risk_level,
       label AS "Actual Class"
FROM r WHERE model = 'amount_geo'""")
def q_prediction_table(spark, sf):
    t = RK.prediction_table(one_model(spark, sf), label_col="label", ts_col="ts")
    return t.withColumn("Timestamp", F.col("Timestamp").cast("string"))


@register("risk_level_counts", sql=f"""
WITH {TIERED_SQL},
t AS (SELECT * FROM (VALUES (0, 'Low Risk'), (1, 'Medium Risk'), (2, 'High Risk')) v(tier_order, risk_level)),
g AS (SELECT DISTINCT model FROM r),
c AS (SELECT model, risk_level, count(*) AS count FROM r GROUP BY model, risk_level),
j AS (SELECT g.model, t.tier_order, t.risk_level, CAST(coalesce(c.count, 0) AS BIGINT) AS count
      FROM g CROSS JOIN t LEFT JOIN c ON c.model = g.model AND c.risk_level = t.risk_level)
SELECT model, tier_order, risk_level, count,
       CASE WHEN sum(count) OVER (PARTITION BY model) > 0
            THEN count * 100.0 / sum(count) OVER (PARTITION BY model) ELSE 0.0 END AS percent
FROM j""")
def q_level_counts(spark, sf):
    return RK.risk_level_counts(tiered(spark, sf), by=BY)


@register("risk_score_histogram", sql=f"""
WITH {TIERED_SQL},
x AS (SELECT risk_score AS x FROM r WHERE model = 'amount_geo' AND risk_score IS NOT NULL),
p AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
w AS (SELECT lo, (hi - lo) / 20.0 AS width FROM p),
b AS (SELECT CAST(CASE WHEN width > 0 THEN least(floor((x - lo) / width), 19) ELSE 0 END AS INTEGER) AS bin FROM x, w),
c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20))
SELECT g.bin, lo + g.bin * width AS bin_lo, lo + (g.bin + 1) * width AS bin_hi, CAST(coalesce(c.count, 0) AS BIGINT) AS count
FROM g CROSS JOIN w LEFT JOIN c ON g.bin = c.bin""")
def q_score_hist(spark, sf):
    return RK.risk_score_histogram(RK.risk_score(one_model(spark, sf)))


@register("batch_run_summary", sql=f"""
WITH {TIERED_SQL},
a AS (SELECT model, count(*) AS processed,
             count(*) FILTER (WHERE prediction = 1) AS predicted_anomalies,
             count(*) FILTER (WHERE prediction <> 1) AS predicted_normal,
             count(*) FILTER (WHERE risk_level = 'High Risk') AS high_risk,
             count(*) FILTER (WHERE risk_level = 'Medium Risk') AS medium_risk,
             count(*) FILTER (WHERE risk_level = 'Low Risk') AS low_risk FROM r GROUP BY model)
SELECT model, processed, predicted_anomalies, predicted_normal, high_risk, medium_risk, low_risk,
       {", ".join(f"CASE WHEN processed > 0 THEN {c} * 100.0 / processed ELSE 0.0 END AS pct_{c}"
                  for c in ["predicted_anomalies", "predicted_normal", "high_risk", "medium_risk", "low_risk"])}
FROM a""")
def q_batch_summary(spark, sf):
    return RK.batch_run_summary(tiered(spark, sf), by=BY)


KPI_SQL = f"""
{TIERED_SQL},
kp AS (SELECT model, count(*) AS total_transactions,
              coalesce(sum(amount), 0) AS total_volume, coalesce(avg(amount), 0) AS mean_amount,
              coalesce(strftime(min(ts), '%Y-%m-%d %H:%M:%S'), 'N/A') AS first_timestamp,
              coalesce(strftime(max(ts), '%Y-%m-%d %H:%M:%S'), 'N/A') AS last_timestamp,
              count(DISTINCT customer_id) AS n_customers,
              count(*) FILTER (WHERE risk_level = 'High Risk') AS high_risk,
              count(*) FILTER (WHERE risk_level = 'Medium Risk') AS medium_risk,
              count(*) FILTER (WHERE risk_level = 'Low Risk') AS low_risk,
              coalesce(avg(risk_score), 0) AS mean_risk_score,
              coalesce(avg(probability) FILTER (WHERE prediction = 1), 0.0) AS mean_anomaly_confidence
       FROM r GROUP BY model)"""

KPI_ROUNDED = ["total_volume", "mean_amount", "mean_risk_score", "mean_anomaly_confidence"]


def kpis(spark, sf):
    k = RK.run_kpis(tiered(spark, sf), by=BY, ts_col="ts", prob_col="probability")
    for c in KPI_ROUNDED:   # float sums depend on summation order: compare at 6 decimals
        k = k.withColumn(c, X.round_half_even(c, 6))
    return k


@register("run_kpis", sql=f"""
WITH {KPI_SQL}
SELECT model, total_transactions, round_even(total_volume, 6) AS total_volume, round_even(mean_amount, 6) AS mean_amount,
       first_timestamp, last_timestamp, n_customers, high_risk, medium_risk, low_risk,
       round_even(mean_risk_score, 6) AS mean_risk_score,
       round_even(mean_anomaly_confidence, 6) AS mean_anomaly_confidence FROM kp""")
def q_run_kpis(spark, sf):
    return kpis(spark, sf)


@register("risk_detail_table", sql=f"""
WITH {TIERED_SQL},
t AS (SELECT * FROM (VALUES (0, 'Low Risk', '0.0 - 20.0'), (1, 'Medium Risk', '20.1 - 60.0'),
                            (2, 'High Risk', '60.1 - 100.0')) v(tier_order, risk_level, score_range)),
g AS (SELECT DISTINCT model FROM r),
c AS (SELECT model, risk_level, count(*) AS count FROM r GROUP BY model, risk_level),
j AS (SELECT g.model, t.tier_order, t.risk_level, t.score_range, CAST(coalesce(c.count, 0) AS BIGINT) AS count
      FROM g CROSS JOIN t LEFT JOIN c ON c.model = g.model AND c.risk_level = t.risk_level)
SELECT model, tier_order, risk_level, score_range, count,
       (CASE WHEN sum(count) OVER (PARTITION BY model) > 0
             THEN count * 100.0 / sum(count) OVER (PARTITION BY model) ELSE 0.0 END) / 100.0 AS proportion
FROM j""")
def q_detail(spark, sf):
    return RK.risk_detail_table(tiered(spark, sf), by=BY)


@register("recommendations", sql=f"""
WITH {KPI_SQL},
k AS (SELECT model, CASE WHEN total_transactions > 0 THEN high_risk * 100.0 / total_transactions ELSE 0.0 END AS ph,
             round_even(mean_risk_score, 6) AS ar, round_even(mean_anomaly_confidence, 6) AS cf FROM kp)
SELECT model, 1 AS rec_no,
       CASE WHEN ph > 5.0 THEN 'High Priority' WHEN ph >= 2.0 THEN 'Medium Priority' ELSE 'Low Priority' END AS level,
       CASE WHEN ph > 5.0 THEN 'Immediate Operational Hold & MFA Enforcement'
            WHEN ph >= 2.0 THEN 'Increased Monitoring & Queue Prioritization'
            ELSE 'Standard Automated Processing' END AS title,
       ph AS metric_value, printf('%.2f%% of transactions are High Risk', ph) AS description FROM k
UNION ALL
SELECT model, 2, CASE WHEN ar > 40.0 THEN 'Medium Priority' ELSE 'Low Priority' END,
       CASE WHEN ar > 40.0 THEN 'Systemic Risk Threshold Audit' ELSE 'Systemic Risk Stable' END,
       ar, printf('average risk score %.1f/100', ar) FROM k
UNION ALL
SELECT model, 3, CASE WHEN cf < 0.85 THEN 'Medium Priority' ELSE 'Low Priority' END,
       CASE WHEN cf < 0.85 THEN 'Uncertain Prediction Audit & Model Retraining' ELSE 'High Confidence Detections' END,
       cf, printf('average anomaly confidence %.1f%%', cf * 100) FROM k WHERE cf > 0""")
def q_recommendations(spark, sf):
    return RK.recommendations(kpis(spark, sf), by=BY)


CHURN_SRC_SQL = """SELECT c_custkey AS customer_id, CAST(c_custkey % 72 AS INTEGER) AS tenure,
       c_acctbal / 100.0 AS monthly_charges FROM customer"""


@register("churn_score", sql=f"""
WITH c AS ({CHURN_SRC_SQL}),
s AS (SELECT *, least(monthly_charges / greatest(tenure, 1) * 0.1, 0.99) AS s FROM c)
SELECT customer_id, tenure, monthly_charges, s > 0.5 AS churn_prediction, round_even(s * 100, 2) AS risk_score FROM s""")
def q_churn(spark, sf):
    c = A.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"), (F.col("c_custkey") % 72).cast("int").alias("tenure"),
        (F.col("c_acctbal") / 100.0).alias("monthly_charges"))
    return RK.churn_score(c)
