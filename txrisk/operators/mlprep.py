"""Model data preparation (M1-M8).

Rows are never split into separate feature / label objects: keys, label and
features stay in one row, and the train / test membership is a column.

The stratified split hits the exact per-class quotas of the usual stratified
shuffle split (train quota by largest remainder, test = the rest of the
class).  Rows are ranked inside their class by ``md5(id:seed)``; the rank is
computed per (class, hash bucket) plus the counts of earlier buckets, so even a
class holding most rows is ranked by thousands of parallel tasks.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline
from pyspark.ml.feature import (ElementwiseProduct, Imputer, OneHotEncoder, StandardScaler, StringIndexer,
                                VectorAssembler)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.operators import stats
from txrisk.operators.features import ENGINEERED_CATEGORICAL, ENGINEERED_NUMERIC

TARGET = "is_anomaly"
KEYS = ["transaction_id", "customer_id"]
SPLIT_BUCKET_HEX = 3          # 16**3 = 4096 hash buckets per class
MAX_LEVELS = 10_000


def select_features(df: DataFrame, keys=KEYS, label_col: str = TARGET,
                    numeric=ENGINEERED_NUMERIC, categorical=ENGINEERED_CATEGORICAL) -> DataFrame:
    """M1: keys + the 11 engineered features + label (label only if present)."""
    cols = [c for c in keys if c in df.columns] + list(numeric) + list(categorical)
    if label_col in df.columns:
        cols.append(label_col)
    return df.select(*cols)


def _fraction(x: float):
    from fractions import Fraction
    fr = Fraction(str(x))          # exactly what was written, e.g. 0.2 = 1/5
    return fr.numerator, fr.denominator


def stratified_split(df: DataFrame, label_col: str = TARGET, id_col: str = "transaction_id",
                     test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """M2: add ``split`` ('train' / 'test') with exact per-class quotas.

    Test rows are the first ``test_quota`` rows of each class in
    ``md5(id || ':' || seed)`` order (ties by id).  The input is read by two
    branches only: the ranked rows, and a partial-aggregated count per
    (class, hash bucket) from which the bucket offsets *and* the class quotas
    are derived (a table of classes x 4096 rows at most).
    """
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    # Null-safe class key (rows without a label rank in their own group and stay in train).
    d = (df.withColumn("_h", h)
           .withColumn("_bk", F.conv(F.substring("_h", 1, SPLIT_BUCKET_HEX), 16, 10).cast("int"))
           .withColumn("_lk", F.coalesce(F.col(label_col).cast("string"), F.lit("\u0000")))
           .withColumn("_hasl", F.col(label_col).isNotNull()))
    bc = d.groupBy("_lk", "_hasl", "_bk").agg(F.count(F.lit(1)).alias("_bc"))
    # Everything below runs on the small (class, bucket) table in one branch:
    # bucket offsets per class, and the class quotas (integer arithmetic; the
    # whole-table windows see at most classes x 4096 rows).
    per_class = Window.partitionBy("_lk")
    earlier = per_class.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    allw = Window.partitionBy()
    num, den = _fraction(test_size)
    bc = (bc.withColumn("_off", F.coalesce(F.sum("_bc").over(earlier), F.lit(0)))
            .withColumn("n_class", F.sum("_bc").over(per_class))
            .withColumn("_first", F.row_number().over(per_class.orderBy("_bk")) == 1))
    labelled_first = F.col("_first") & F.col("_hasl")
    n_all = F.sum(F.when(labelled_first, F.col("n_class"))).over(allw)
    bc = bc.withColumn("_N", n_all).withColumn(
        "_ntrain", F.col("_N") - F.floor((F.col("_N") * num + den - 1) / den).cast("long"))
    prod = F.col("n_class") * F.col("_ntrain")
    bc = bc.withColumn("_fl", F.floor(prod / F.col("_N")).cast("long")).withColumn("_rem", prod % F.col("_N"))
    bc = bc.withColumn("_left", F.col("_ntrain") - F.sum(F.when(labelled_first, F.col("_fl"))).over(allw))
    # labelled classes first, so the unlabelled group never takes a remainder seat
    bc = bc.withColumn("_r", F.dense_rank().over(allw.orderBy(F.desc("_hasl"), F.desc("_rem"), F.asc("_lk"))))
    offsets = bc.select("_lk", "_bk", "_off", (F.col("n_class") - F.col("_fl")
                                               - (F.col("_r") <= F.col("_left")).cast("long")).alias("test_quota"))
    within = Window.partitionBy("_lk", "_bk").orderBy("_h", id_col)
    d = d.withColumn("_rn", F.row_number().over(within))
    j = d.join(offsets, ["_lk", "_bk"])
    rank = F.col("_off") + F.col("_rn")
    quota = F.when(F.col("_hasl"), F.coalesce(F.col("test_quota"), F.lit(0))).otherwise(F.lit(0))
    return (j.withColumn("split", F.when(rank <= quota, F.lit("test")).otherwise(F.lit("train")))
             .drop("_h", "_bk", "_rn", "_off", "_lk", "_hasl", "test_quota"))


def fit_scaler(train: DataFrame, cols=ENGINEERED_NUMERIC) -> DataFrame:
    """M3 (fit): one row of ``mean_<c>`` and ``scale_<c>`` (population sd; 0 -> 1)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"mean_{c}"), F.stddev_pop(x).alias(f"_sd_{c}")]
    s = train.agg(*aggs)
    return s.select(*[F.col(f"mean_{c}") for c in cols],
                    *[F.when(F.col(f"_sd_{c}") > 0, F.col(f"_sd_{c}")).otherwise(F.lit(1.0)).alias(f"scale_{c}")
                      for c in cols])


def standard_scale(df: DataFrame, stats: DataFrame, cols=ENGINEERED_NUMERIC, suffix: str = "") -> DataFrame:
    """M3 (apply): (x - mean) / scale with the fitted one-row stats (scalar subqueries)."""
    out = df
    for c in cols:
        mean = stats.select(f"mean_{c}").scalar()
        scale = stats.select(f"scale_{c}").scalar()
        out = out.withColumn(c + suffix, (F.col(c).cast("double") - mean) / scale)
    return out


def category_levels(train: DataFrame, cols=ENGINEERED_CATEGORICAL, max_levels: int = MAX_LEVELS) -> dict:
    """Sorted distinct levels per categorical column, of all columns in one pass.

    A column of more than ``max_levels`` levels is an error; that many a column reach the driver."""
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in cols])
    each = train.select(F.inline(pairs)).where(F.col("v").isNotNull()).distinct()
    first = Window.partitionBy("k").orderBy("v")
    rows = each.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= max_levels + 1).select("k", "v").collect()
    levels = {c: sorted(r.v for r in rows if r.k == c) for c in cols}
    for c, vals in levels.items():
        if len(vals) > max_levels:
            raise ValueError(f"{c}: more than {max_levels} levels; use hashing instead")
    return levels


def one_hot_encode(df: DataFrame, levels: dict, keep=None) -> DataFrame:
    """M4: one 0/1 column ``<col>_<level>`` per training level; unseen values are all zeros."""
    keep = list(keep if keep is not None else [c for c in df.columns if c not in levels])
    exprs = [F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
             for c, vs in levels.items() for v in vs]
    return df.select(*keep, *exprs)


def level_table(train: DataFrame, cols=ENGINEERED_CATEGORICAL) -> DataFrame:
    """M4 without a bound: ``column, value, slot`` for every training level, slots gapless in order of (column
    place, value) as the wide form has them. The levels stay a table: no list on the driver, no column a level."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("value")) for i, c in enumerate(cols)])
    each = train.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()
    names = F.array(*[F.lit(c) for c in cols])
    return stats.numbered(each, ["i", "value"], "slot").select(F.get(names, F.col("i")).alias("column"), "value", "slot")


def one_hot_sparse(df: DataFrame, levels: DataFrame, cols=ENGINEERED_CATEGORICAL, keep=None, slots: str = "slots") -> DataFrame:
    """M4 (apply): ``keep`` and the sorted slots of the ones, the sparse form of the 0/1 vector; unseen and missing values have none.

    Levels are broadcast where a count shows at most ``stats.BROADCAST_ROWS`` of them; more are joined by value, where
    adaptive execution splits the values that hold many rows."""
    keep = list(keep if keep is not None else [c for c in df.columns if c not in cols])
    few = levels.count() <= stats.BROADCAST_ROWS
    out = df.select(*keep, *[F.col(c).cast("string").alias(f"_v{i}") for i, c in enumerate(cols)])
    for i, c in enumerate(cols):
        own = levels.where(F.col("column") == c).select(F.col("value").alias(f"_v{i}"), F.col("slot").alias(f"_s{i}"))
        out = out.join(F.broadcast(own) if few else own, f"_v{i}", "left")
    ones = F.filter(F.array(*[F.col(f"_s{i}") for i in range(len(cols))]), lambda x: x.isNotNull())
    return out.select(*keep, F.array_sort(ones).alias(slots))


def feature_pipeline(train: DataFrame, numeric=ENGINEERED_NUMERIC, categorical=ENGINEERED_CATEGORICAL,
                     output_col: str = "features"):
    """M5: fitted Spark ML pipeline -> ``features`` vector (numeric z-scores + one-hot).

    Missing numeric inputs are filled with the training median (Spark ML
    ``Imputer``; its median is approximate, relative error 0.001) before scaling.

    ``StandardScaler`` divides by the sample sd; an ``ElementwiseProduct`` by
    sqrt(n / (n - 1)) turns that into the population sd of the reference.
    ``StringIndexer(handleInvalid="keep")`` + ``OneHotEncoder(dropLast=True)``
    gives every training level a slot and maps unseen values to all zeros.
    """
    n = train.count()
    factor = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    idx_cols = [f"{c}__idx" for c in categorical]
    ohe_cols = [f"{c}__ohe" for c in categorical]
    imp_cols = [f"__imp_{c}" for c in numeric]
    stages = [
        # Missing numeric inputs (an amount text that did not parse, a window with no
        # amounts) get the training median, so no row is dropped and the fit sees no NaN.
        Imputer(inputCols=list(numeric), outputCols=imp_cols, strategy="median"),
        VectorAssembler(inputCols=imp_cols, outputCol="__num", handleInvalid="keep"),
        StandardScaler(inputCol="__num", outputCol="__num_s", withMean=True, withStd=True),
        ElementwiseProduct(scalingVec=Vectors.dense([factor] * len(numeric)), inputCol="__num_s",
                           outputCol="__num_z"),
        StringIndexer(inputCols=list(categorical), outputCols=idx_cols, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=idx_cols, outputCols=ohe_cols, dropLast=True),
        VectorAssembler(inputCols=["__num_z"] + ohe_cols, outputCol=output_col),
    ]
    return Pipeline(stages=stages).fit(_model_types(train, numeric, categorical))


def _model_types(df: DataFrame, numeric, categorical) -> DataFrame:
    out = df
    for c in numeric:
        out = out.withColumn(c, F.col(c).cast("double"))
    for c in categorical:
        out = out.withColumn(c, F.col(c).cast("string"))
    return out


def pipeline_feature_names(model, numeric=ENGINEERED_NUMERIC, categorical=ENGINEERED_CATEGORICAL):
    """Slot names of the ``features`` vector: numeric columns, then ``<col>_<level>``
    per training level in alphabetical order (the reference's naming)."""
    from pyspark.ml.feature import StringIndexerModel
    indexer = next(st for st in model.stages if isinstance(st, StringIndexerModel))
    names = list(numeric)
    for c, labels in zip(categorical, indexer.labelsArray):
        names += [f"{c}_{v}" for v in labels]
    return names


def apply_pipeline(model, df: DataFrame, categorical=ENGINEERED_CATEGORICAL,
                   numeric=ENGINEERED_NUMERIC) -> DataFrame:
    res = model.transform(_model_types(df, [c for c in numeric if c in df.columns], categorical))
    return res.drop(*[c for c in res.columns if c not in df.columns and c != "features"])


def split_report(df: DataFrame, label_col: str = TARGET, n_features: int | None = None) -> DataFrame:
    """M7: rows and anomaly rate of each split (+ encoded width when given)."""
    out = df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.avg(F.col(label_col).cast("double")).alias("anomaly_rate"))
    if n_features is not None:
        out = out.withColumn("n_features", F.lit(int(n_features)))
    return out


def test_metadata(df: DataFrame, keys=("transaction_id", "customer_id", "timestamp"),
                  label_col: str = TARGET) -> DataFrame:
    """M8: keys and label of the test rows (keys ride along; no positional re-alignment)."""
    cols = [c for c in keys if c in df.columns] + ([label_col] if label_col in df.columns else [])
    return df.where(F.col("split") == "test").select(*cols)
