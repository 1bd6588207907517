"""Risk scoring, tiers and run reporting.

The threshold policy is either keyword arguments or a one-row policy frame
(``sources.io.risk_policy``); a one-row frame is read through scalar
subqueries, so it never becomes a join.  Run-level results (KPIs,
recommendations) stay DataFrames with optional ``by`` keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.functions import expressions as X

TIERS = X.RISK_LEVELS
TIER_ORDER = {t: i for i, t in enumerate(TIERS)}


def _thresholds(policy, low, high):
    if policy is not None:
        return (policy.select("low_risk_threshold").scalar(),
                policy.select("high_risk_threshold").scalar())
    return F.lit(float(low)), F.lit(float(high))


def risk_score(df: DataFrame, prob_col: str = "probability", out_col: str = "risk_score") -> DataFrame:
    """R2: round(p x 100, 2), half-even."""
    return df.withColumn(out_col, X.risk_score(prob_col))


def risk_level(df: DataFrame, prob_col: str = "probability", low=X.DEFAULT_LOW_RISK_THRESHOLD,
               high=X.DEFAULT_HIGH_RISK_THRESHOLD, policy: DataFrame | None = None,
               out_col: str = "risk_level") -> DataFrame:
    """Tier of the unrounded probability under the policy thresholds."""
    lo, hi = _thresholds(policy, low, high)
    return df.withColumn(out_col, X.risk_level(prob_col, lo, hi))


def prediction_table(df: DataFrame, prob_col: str = "probability", pred_col: str = "prediction",
                     label_col: str = "is_anomaly", ts_col: str = "timestamp",
                     low=X.DEFAULT_LOW_RISK_THRESHOLD, high=X.DEFAULT_HIGH_RISK_THRESHOLD,
                     policy: DataFrame | None = None) -> DataFrame:
    """Keys + prediction + probability + score + tier + truth, renamed and ordered."""
    lo, hi = _thresholds(policy, low, high)
    return df.select(
        F.col("transaction_id").alias("Transaction ID"),
        F.col("customer_id").alias("Customer ID"),
        F.col(ts_col).alias("Timestamp"),
        F.col(pred_col).cast("int").alias("prediction"),
        F.col(prob_col).alias("probability_score"),
        X.risk_score(prob_col).alias("risk_score"),
        X.risk_level(prob_col, lo, hi).alias("risk_level"),
        F.col(label_col).alias("Actual Class"))


def risk_summary(df: DataFrame, level_col: str = "risk_level", by=None,
                 low=X.DEFAULT_LOW_RISK_THRESHOLD, high=X.DEFAULT_HIGH_RISK_THRESHOLD,
                 policy: DataFrame | None = None) -> DataFrame:
    """Total, count and percent (2 dp) per tier, with the thresholds attached."""
    by = list(by or [])
    lvl = F.col(level_col)
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.count_if(lvl == TIERS[2]).alias("high_risk_cases"),
        F.count_if(lvl == TIERS[1]).alias("medium_risk_cases"),
        F.count_if(lvl == TIERS[0]).alias("low_risk_cases"))
    lo, hi = _thresholds(policy, low, high)

    def pct(c):
        return X.round_half_even(F.col(c) * 100.0 / F.col("total_predictions"), 2)

    return agg.select(*by, "total_predictions", "high_risk_cases", "medium_risk_cases", "low_risk_cases",
                      pct("high_risk_cases").alias("percentage_high_risk"),
                      pct("medium_risk_cases").alias("percentage_medium_risk"),
                      pct("low_risk_cases").alias("percentage_low_risk"),
                      lo.alias("low_risk_threshold"), hi.alias("high_risk_threshold"))


def risk_level_counts(df: DataFrame, level_col: str = "risk_level", by=None) -> DataFrame:
    """Count and percent per tier; absent tiers appear with 0, in Low / Medium / High order."""
    by = list(by or [])
    counts = df.groupBy(*by, level_col).agg(F.count(F.lit(1)).alias("count"))
    tiers = F.array(*[F.struct(F.lit(i).alias("tier_order"), F.lit(t).alias(level_col))
                      for i, t in enumerate(TIERS)])
    if by:   # groups taken from the (small) aggregated counts, not from another pass over df
        dims = counts.select(*by).distinct().select(*by, F.inline(tiers))
    else:
        dims = df.sparkSession.range(1).select(F.inline(tiers))
    j = dims.join(counts, by + [level_col], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    total = j.groupBy(*by).agg(F.sum("count").alias("_t"))
    j = j.join(total, by) if by else j.withColumn("_t", total.select("_t").scalar())
    return j.select(*by, "tier_order", level_col, "count",
                    F.when(F.col("_t") > 0, F.col("count") * 100.0 / F.col("_t")).otherwise(F.lit(0.0))
                    .alias("percent"))


def risk_score_histogram(df: DataFrame, score_col: str = "risk_score", bins: int = 20, by=None) -> DataFrame:
    """Equal-width histogram of the risk score (P19 with 20 bins), optionally per group."""
    from txrisk.operators.profiling import fixed_bin_histogram
    return fixed_bin_histogram(df, score_col, bins=bins, by=by)


def batch_run_summary(df: DataFrame, pred_col: str = "prediction", level_col: str = "risk_level",
                      by=None) -> DataFrame:
    """Processed rows, predicted anomaly / normal and tier counts with percents."""
    by = list(by or [])
    pred, lvl = F.col(pred_col), F.col(level_col)
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(pred == 1).alias("predicted_anomalies"),
        F.count_if(pred != 1).alias("predicted_normal"),
        F.count_if(lvl == TIERS[2]).alias("high_risk"),
        F.count_if(lvl == TIERS[1]).alias("medium_risk"),
        F.count_if(lvl == TIERS[0]).alias("low_risk"))
    cols = ["predicted_anomalies", "predicted_normal", "high_risk", "medium_risk", "low_risk"]
    return agg.select(*by, "processed", *cols, *[
        F.when(F.col("processed") > 0, F.col(c) * 100.0 / F.col("processed")).otherwise(F.lit(0.0))
        .alias(f"pct_{c}") for c in cols])


def run_kpis(df: DataFrame, by=None, amount_col: str = "amount", ts_col: str = "timestamp",
             customer_col: str = "customer_id", pred_col: str = "prediction",
             prob_col: str = "probability_score", score_col: str = "risk_score",
             level_col: str = "risk_level") -> DataFrame:
    """Run KPIs; a missing input column gives 0 (numbers) or "N/A" (times)."""
    by = list(by or [])
    has = set(df.columns)
    lvl = F.col(level_col) if level_col in has else F.lit(None).cast("string")
    pred = F.col(pred_col) if pred_col in has else F.lit(None).cast("int")
    prob = F.col(prob_col) if prob_col in has else F.lit(None).cast("double")

    def num(c, fn):
        return F.coalesce(fn(F.col(c)), F.lit(0)).cast("double") if c in has else F.lit(0.0)

    def tfmt(fn):
        return (F.coalesce(F.date_format(fn(F.col(ts_col)), "yyyy-MM-dd HH:mm:ss"), F.lit("N/A"))
                if ts_col in has else F.lit("N/A"))

    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        num(amount_col, F.sum).alias("total_volume"),
        num(amount_col, F.avg).alias("mean_amount"),
        tfmt(F.min).alias("first_timestamp"),
        tfmt(F.max).alias("last_timestamp"),
        (F.count_distinct(customer_col) if customer_col in has else F.lit(0)).cast("long").alias("n_customers"),
        F.count_if(lvl == TIERS[2]).alias("high_risk"),
        F.count_if(lvl == TIERS[1]).alias("medium_risk"),
        F.count_if(lvl == TIERS[0]).alias("low_risk"),
        num(score_col, F.avg).alias("mean_risk_score"),
        F.coalesce(F.avg(F.when(pred == 1, prob)), F.lit(0.0)).alias("mean_anomaly_confidence"))


def risk_detail_table(df: DataFrame, level_col: str = "risk_level", by=None,
                      low=X.DEFAULT_LOW_RISK_THRESHOLD, high=X.DEFAULT_HIGH_RISK_THRESHOLD) -> DataFrame:
    """Tier, score-range label (from the policy), count, proportion."""
    lo, hi = round(low * 100, 1), round(high * 100, 1)
    labels = {TIERS[0]: f"0.0 - {lo}", TIERS[1]: f"{lo + 0.1:.1f} - {hi}", TIERS[2]: f"{hi + 0.1:.1f} - 100.0"}
    rng = F.create_map(*[x for t in TIERS for x in (F.lit(t), F.lit(labels[t]))])
    c = risk_level_counts(df, level_col, by)
    return c.select(*(by or []), "tier_order", level_col, rng[F.col(level_col)].alias("score_range"),
                    "count", (F.col("percent") / 100.0).alias("proportion"))


# Fixed values of the recommendation rules.
HIGH_RISK_PCT_CRITICAL = 5.0
HIGH_RISK_PCT_ELEVATED = 2.0
MEAN_RISK_ELEVATED = 40.0
CONFIDENCE_LOW = 0.85
REC_TITLES = {
    "hold": ("High Priority", "Immediate Operational Hold & MFA Enforcement"),
    "monitor": ("Medium Priority", "Increased Monitoring & Queue Prioritization"),
    "standard": ("Low Priority", "Standard Automated Processing"),
    "audit": ("Medium Priority", "Systemic Risk Threshold Audit"),
    "stable": ("Low Priority", "Systemic Risk Stable"),
    "retrain": ("Medium Priority", "Uncertain Prediction Audit & Model Retraining"),
    "confident": ("Low Priority", "High Confidence Detections"),
}


def recommendations(kpis: DataFrame, by=None) -> DataFrame:
    """2-3 rule-based recommendation rows per run from the R9 KPI row."""
    by = list(by or [])
    total = F.col("total_transactions")
    pct_high = F.when(total > 0, F.col("high_risk") * 100.0 / total).otherwise(F.lit(0.0))
    avg_risk = F.col("mean_risk_score")
    conf = F.col("mean_anomaly_confidence")

    def rec(no, key, metric, text):
        lvl, title = REC_TITLES[key]
        return F.struct(F.lit(no).alias("rec_no"), F.lit(lvl).alias("level"), F.lit(title).alias("title"),
                        metric.alias("metric_value"), text.alias("description"))

    r1 = (F.when(pct_high > HIGH_RISK_PCT_CRITICAL,
                 rec(1, "hold", pct_high, F.format_string("%.2f%% of transactions are High Risk", pct_high)))
           .when(pct_high >= HIGH_RISK_PCT_ELEVATED,
                 rec(1, "monitor", pct_high, F.format_string("%.2f%% of transactions are High Risk", pct_high)))
           .otherwise(rec(1, "standard", pct_high, F.format_string("%.2f%% of transactions are High Risk", pct_high))))
    r2 = (F.when(avg_risk > MEAN_RISK_ELEVATED,
                 rec(2, "audit", avg_risk, F.format_string("average risk score %.1f/100", avg_risk)))
           .otherwise(rec(2, "stable", avg_risk, F.format_string("average risk score %.1f/100", avg_risk))))
    r3 = (F.when((conf < CONFIDENCE_LOW) & (conf > 0),
                 rec(3, "retrain", conf, F.format_string("average anomaly confidence %.1f%%", conf * 100)))
           .when(conf >= CONFIDENCE_LOW,
                 rec(3, "confident", conf, F.format_string("average anomaly confidence %.1f%%", conf * 100))))
    out = kpis.select(*by, F.explode(F.array(r1, r2, r3)).alias("r")).where(F.col("r").isNotNull())
    return out.select(*by, "r.*")


def churn_score(df: DataFrame, monthly_col: str = "monthly_charges", tenure_col: str = "tenure") -> DataFrame:
    """Closed-form churn score: flag s > 0.5 and score round(s x 100, 2)."""
    s = X.churn_score(monthly_col, tenure_col)
    return (df.withColumn("churn_prediction", s > 0.5)
              .withColumn("risk_score", X.round_half_even(s * 100, 2)))
