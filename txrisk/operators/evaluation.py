"""Evaluation aggregates over a scored table ``(label, prediction, probability)``.

Every operator takes ``by=[...]`` grouping keys (model, day, segment); with none
it is the single-run answer of the reference.  Curve operators collapse rows to
one row per (group, distinct score) first; running totals over scores are then
computed per (group, score bucket) plus the totals of earlier buckets, so no
single task has to hold all distinct scores of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions import expressions as X
from txrisk.session import persist_shared



def _by(by):
    return list(by or [])


def _counts(df, by, label_col, pred_col):
    lab, pred = F.col(label_col), F.col(pred_col)
    return df.groupBy(*by).agg(
        F.count_if((lab == 0) & (pred == 0)).alias("tn"),
        F.count_if((lab == 0) & (pred == 1)).alias("fp"),
        F.count_if((lab == 1) & (pred == 0)).alias("fn"),
        F.count_if((lab == 1) & (pred == 1)).alias("tp"))


def _ratio(num, den):
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def confusion_matrix(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                     by=None) -> DataFrame:
    """Long 2x2 matrix ``actual, predicted, count``; zero cells are present."""
    by = _by(by)
    c = _counts(df, by, label_col, pred_col)
    cells = F.array(
        F.struct(F.lit(0).alias("actual"), F.lit(0).alias("predicted"), F.col("tn").alias("count")),
        F.struct(F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.col("fp").alias("count")),
        F.struct(F.lit(1).alias("actual"), F.lit(0).alias("predicted"), F.col("fn").alias("count")),
        F.struct(F.lit(1).alias("actual"), F.lit(1).alias("predicted"), F.col("tp").alias("count")))
    return c.select(*by, F.inline(cells))


def classification_metrics(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                           by=None) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 (0 when a denominator is 0)."""
    by = _by(by)
    c = _counts(df, by, label_col, pred_col)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*by, "tn", "fp", "fn", "tp",
                    _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                    _ratio(tp, tp + fp).alias("precision"),
                    _ratio(tp, tp + fn).alias("recall"),
                    _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def classification_report(df: DataFrame, label_col: str = "label", pred_col: str = "prediction",
                          by=None) -> DataFrame:
    """E5: per class precision / recall / F1 / support, accuracy, macro and weighted averages."""
    by = _by(by)
    c = _counts(df, by, label_col, pred_col)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    p1, r1, f1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    acc = _ratio(tp + tn, n)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class_label"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.cast("long").alias("support"))

    rows = F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1, s1),
        row("accuracy", acc, acc, acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", _ratio(p0 * s0 + p1 * s1, n), _ratio(r0 * s0 + r1 * s1, n),
            _ratio(f0 * s0 + f1 * s1, n), n))
    return c.select(*by, F.inline(rows))


def score_counts(df: DataFrame, label_col: str = "label", score_col: str = "probability",
                 by=None, buckets: int | None = None, keep_bucket: bool = False) -> DataFrame:
    """Per (group, distinct score): ``pos, neg`` and running totals in both directions.

    ``cum_pos_ge / cum_neg_ge`` count rows with score >= s (descending sweep),
    ``neg_lt`` counts negatives with score < s.  Running totals are taken per
    (group, score bucket) and offset by the totals of higher buckets.  ``buckets``:
    ranges of the scores, by default the shuffle partitions.
    """
    by = _by(by)
    s = F.col(score_col).cast("double")
    d = (df.where(F.col(score_col).isNotNull())
           .groupBy(*by, s.alias("score"))
           .agg(F.count_if(F.col(label_col) == 1).alias("pos"),
                F.count_if(F.col(label_col) != 1).alias("neg")))
    # Buckets by rank: ranges of (group, score) with about equal numbers of distinct scores, however the
    # scores lie; their numbers rise with the score inside a group.  Two consumers below (running sums,
    # bucket totals) must see the same buckets, so the ranged aggregate is persisted.
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = persist_shared(d.repartitionByRange(n, *by, "score").withColumn("_b", F.spark_partition_id()))
    within = (Window.partitionBy(*by, "_b").orderBy(F.desc("score"))
              .rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_wp", F.sum("pos").over(within)).withColumn("_wn", F.sum("neg").over(within))
    tot = d.groupBy(*by, "_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    higher = (Window.partitionBy(*by).orderBy(F.desc("_b"))
              .rowsBetween(Window.unboundedPreceding, -1))
    tot = tot.select(*by, "_b",
                     F.coalesce(F.sum("_bp").over(higher), F.lit(0)).alias("_op"),
                     F.coalesce(F.sum("_bn").over(higher), F.lit(0)).alias("_on"),
                     F.sum("_bp").over(Window.partitionBy(*by)).alias("n_pos"),
                     F.sum("_bn").over(Window.partitionBy(*by)).alias("n_neg"))
    out = d.join(tot, by + ["_b"]).select(
        *by, *(["_b"] if keep_bucket else []), "score", "pos", "neg",
        (F.col("_wp") + F.col("_op")).alias("cum_pos_ge"),
        (F.col("_wn") + F.col("_on")).alias("cum_neg_ge"), "n_pos", "n_neg")
    return out.withColumn("neg_lt", F.col("n_neg") - F.col("cum_neg_ge"))


def roc_auc(df: DataFrame, label_col: str = "label", score_col: str = "probability", by=None) -> DataFrame:
    """Exact ROC AUC with tied scores counted one half (Mann-Whitney)."""
    by = _by(by)
    sc = score_counts(df, label_col, score_col, by)
    agg = sc.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("neg_lt") + 0.5 * F.col("neg"))).alias("_u"),
        F.first("n_pos").alias("_p"), F.first("n_neg").alias("_n"))
    return agg.select(*by, F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                  F.col("_u") / (F.col("_p").cast("double") * F.col("_n").cast("double")))
                      .alias("roc_auc"))


def roc_curve(df: DataFrame, label_col: str = "label", score_col: str = "probability", by=None,
              drop_intermediate: bool = True) -> DataFrame:
    """``point, threshold, fpr, tpr``; starts at (0, 0) with a NULL threshold.

    ``drop_intermediate`` drops interior points collinear with their neighbours
    (second differences of the cumulative counts both zero, i.e. the next
    lower score has the same positive and negative counts).  Neighbours and
    point numbers are found per (group, score bucket), with the values that
    cross bucket edges taken from small per-bucket tables, so no task holds
    all distinct scores of a group.
    """
    by = _by(by)
    sc = score_counts(df, label_col, score_col, by, keep_bucket=True)
    in_bucket = Window.partitionBy(*by, "_b").orderBy(F.desc("score"))
    sc = sc.withColumn("_np", F.lead("pos").over(in_bucket)).withColumn("_nn", F.lead("neg").over(in_bucket))
    heads = sc.groupBy(*by, "_b").agg(F.max_by(F.struct("pos", "neg"), "score").alias("_h"),
                                      F.max("score").alias("_hs"))
    lower = Window.partitionBy(*by).orderBy(F.desc("_b"))
    heads = heads.select(*by, "_b", F.lead("_h").over(lower).alias("_nh"),
                         F.max("_hs").over(Window.partitionBy(*by)).alias("_top"))
    sc = sc.join(heads, by + ["_b"])
    nxt_pos = F.coalesce(F.col("_np"), F.col("_nh.pos"))
    nxt_neg = F.coalesce(F.col("_nn"), F.col("_nh.neg"))
    if drop_intermediate:
        keep = ((F.col("score") == F.col("_top")) | nxt_pos.isNull()
                | (nxt_pos != F.col("pos")) | (nxt_neg != F.col("neg")))
        sc = sc.where(keep)
    # Point numbers: rank inside the bucket + kept points of higher buckets (+1 for the start point).
    sc = sc.withColumn("_r", F.row_number().over(in_bucket))
    per_bucket = sc.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_k"))
    higher = Window.partitionBy(*by).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select(*by, "_b", F.coalesce(F.sum("_k").over(higher), F.lit(0)).alias("_off"))
    curve = sc.join(per_bucket, by + ["_b"]).select(
        *by, (F.col("_off") + F.col("_r")).cast("int").alias("point"), F.col("score").alias("threshold"),
        F.col("cum_neg_ge").alias("fps"), F.col("cum_pos_ge").alias("tps"), "n_pos", "n_neg")
    start = curve.groupBy(*by).agg(F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg")) \
        .select(*by, F.lit(0).alias("point"), F.lit(None).cast("double").alias("threshold"),
                F.lit(0).cast("long").alias("fps"), F.lit(0).cast("long").alias("tps"), "n_pos", "n_neg")
    return curve.unionByName(start).select(
        *by, "point", "threshold", _ratio(F.col("fps"), F.col("n_neg")).alias("fpr"),
        _ratio(F.col("tps"), F.col("n_pos")).alias("tpr"))


def pr_curve(df: DataFrame, label_col: str = "label", score_col: str = "probability", by=None) -> DataFrame:
    """``threshold, precision, recall`` per distinct score, plus the end point (recall 0, precision 1)."""
    by = _by(by)
    sc = score_counts(df, label_col, score_col, by)
    tp, fp = F.col("cum_pos_ge"), F.col("cum_neg_ge")
    pts = sc.select(*by, F.col("score").alias("threshold"),
                    _ratio(tp, tp + fp).alias("precision"),
                    F.when(F.col("n_pos") == 0, F.lit(1.0))
                     .otherwise(tp.cast("double") / F.col("n_pos").cast("double")).alias("recall"))
    end = sc.select(*by).distinct().select(*by, F.lit(None).cast("double").alias("threshold"),
                                           F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def average_precision(df: DataFrame, label_col: str = "label", score_col: str = "probability",
                      by=None, digits: int = 12) -> DataFrame:
    """Step-wise AP = sum over thresholds of (recall gain) x precision."""
    by = _by(by)
    sc = score_counts(df, label_col, score_col, by)
    tp, fp = F.col("cum_pos_ge"), F.col("cum_neg_ge")
    prec = tp.cast("double") / (tp + fp).cast("double")
    agg = sc.groupBy(*by).agg(F.sum(F.col("pos") * prec).alias("_s"), F.first("n_pos").alias("_p"))
    return agg.select(*by, X.round_half_even(F.when(F.col("_p") > 0, F.col("_s") / F.col("_p")).otherwise(F.lit(0.0)),
                                    digits).alias("average_precision"))


def compare_models(df: DataFrame, model_col: str = "model", label_col: str = "label",
                   pred_col: str = "prediction", score_col: str = "probability") -> DataFrame:
    """One row per model: accuracy, precision, recall, f1_score, roc_auc."""
    m = classification_metrics(df, label_col, pred_col, by=[model_col])
    a = roc_auc(df, label_col, score_col, by=[model_col])
    return m.join(a, model_col).select(model_col, "accuracy", "precision", "recall",
                                       F.col("f1").alias("f1_score"), "roc_auc")


def metric_improvement(comparison: DataFrame, base_model: str, tuned_model: str,
                       model_col: str = "model", metrics=("f1_score", "recall")) -> DataFrame:
    """Relative gain of ``tuned_model`` over ``base_model`` per metric (0 when base is 0)."""
    rows = comparison.where(F.col(model_col).isin(base_model, tuned_model))
    long = rows.unpivot([model_col], list(metrics), "metric", "value")
    piv = long.groupBy("metric").agg(
        F.max(F.when(F.col(model_col) == base_model, F.col("value"))).alias("base"),
        F.max(F.when(F.col(model_col) == tuned_model, F.col("value"))).alias("tuned"))
    gain = F.when(F.col("base") != 0, (F.col("tuned") - F.col("base")) / F.col("base")).otherwise(F.lit(0.0))
    return piv.withColumn("improvement", gain)


METRIC_NAMES = [("accuracy", "Accuracy"), ("precision", "Precision"), ("recall", "Recall"),
                ("f1_score", "F1-Score")]


def metrics_long(comparison: DataFrame, model_col: str = "model") -> DataFrame:
    """Wide comparison -> long ``model, metric, score`` for four metrics."""
    return comparison.select(model_col, F.inline(F.array(*[
        F.struct(F.lit(label).alias("metric"), F.col(c).alias("score")) for c, label in METRIC_NAMES])))


# Fixed label column candidates, in lookup order.
LABEL_CANDIDATES = ["is_anomaly", "Actual Class", "actual", "is_churn"]


def run_level_metrics(df: DataFrame, pred_col: str = "prediction", by=None) -> DataFrame:
    """E3 on a scored batch, only if a label column exists and holds more than one class.

    Returns no rows otherwise."""
    label = next((c for c in LABEL_CANDIDATES if c in df.columns), None)
    if label is None:
        return classification_metrics(df.withColumn("_l", F.lit(0)), "_l", pred_col, by).limit(0)
    if not by:
        n_classes = df.agg(F.count_distinct(label)).scalar()
        return classification_metrics(df.where(n_classes > 1), label, pred_col, by).where(
            (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")) > 0)
    # per group: the least and the greatest label differ (combined before the shuffle)
    groups = df.groupBy(*_by(by)).agg(F.min(label).alias("_a"), F.max(label).alias("_b"))
    several = groups.where(F.col("_a") != F.col("_b")).drop("_a", "_b")
    return classification_metrics(df, label, pred_col, by).join(several, _by(by), "left_semi")
