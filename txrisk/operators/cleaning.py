"""Cleaning operators (C1-C10) on the all-string raw transaction table.

Statistics used for imputation (median, mode) are one-row results of
distributed aggregates, attached as scalar subqueries (``DataFrame.scalar()``):
the planner runs the aggregate once and inlines the value, so no value passes
through Python and no join is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.functions import expressions as X
from txrisk.operators import stats

# Column roles (fixed values of the transaction schema).
TARGET_COLUMN = "is_anomaly"
NUMERIC_COLUMNS = ["amount"]
CATEGORICAL_COLUMNS = ["merchant_category", "location", "device_type"]
KEY_COLUMNS = ["transaction_id", "customer_id", "timestamp"]


def _present(df: DataFrame, cols):
    return [c for c in cols if c in df.columns]


def _keys(ts_col: str):
    return [ts_col if c == "timestamp" else c for c in KEY_COLUMNS]


def clean_duplicates(df: DataFrame) -> DataFrame:
    """Remove exact duplicate rows (NULLs compare equal)."""
    return df.dropDuplicates()


def median_fills(df: DataFrame, cols) -> dict:
    """Exact medians of the parseable values of several columns, as scalar subqueries over one selection."""
    if not cols:
        return {}
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).try_cast("double").alias("_x")) for c in cols])
    med = stats.exact_median(df.select(F.inline(values)), "_x", by=["column"])
    return {c: med.where(F.col("column") == c).agg(F.max("median")).scalar() for c in cols}   # exactly one row each


def _fill(df: DataFrame, fills: dict) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c), fills[c].cast(df.schema[c].dataType)).alias(c) if c in fills
                       else F.col(c) for c in df.columns])


def impute_median(df: DataFrame, cols=None) -> DataFrame:
    """Numeric columns: missing -> exact column median of the parseable values.

    Text that does not parse is *not* imputed; it becomes NULL only later, at
    type coercion, as in the reference order of steps.
    """
    cols = _present(df, NUMERIC_COLUMNS if cols is None else cols)
    return _fill(df, median_fills(df, cols))


def mode_fills(df: DataFrame, cols, fallback=None) -> dict:
    """Fill values for several categorical columns from one pass over ``df``."""
    if not cols:
        return {}
    m = stats.modes_map(df, cols)
    return {c: (F.coalesce(m[F.lit(c)], F.lit(fallback)) if fallback is not None else m[F.lit(c)])
            for c in cols}


def mode_fills_from_counts(counts: DataFrame, cols) -> dict:
    """Fill values for ``cols`` from (k, v, n) value counts."""
    if not cols:
        return {}
    m = stats.modes_of_counts(counts)
    return {c: m[F.lit(c)] for c in cols}


def _attach_modes(df: DataFrame, cols, fallback=None) -> DataFrame:
    return _fill(df, mode_fills(df, cols, fallback))


def impute_mode(df: DataFrame, cols=None) -> DataFrame:
    """Categorical columns: missing -> most frequent value (ties -> smallest).

    A column with no values at all stays NULL here (the training path of the
    reference fails on it); see ``impute_mode_unknown`` for the scoring path.
    """
    cols = _present(df, CATEGORICAL_COLUMNS if cols is None else cols)
    return _attach_modes(df, cols)


def impute_mode_unknown(df: DataFrame, cols=None) -> DataFrame:
    """C4: like C3, but an all-missing column is filled with "unknown"."""
    cols = _present(df, CATEGORICAL_COLUMNS if cols is None else cols)
    return _attach_modes(df, cols, fallback="unknown")


def drop_null_critical(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """Drop rows missing a key column or the target (only columns present)."""
    subset = _present(df, _keys(ts_col) + [TARGET_COLUMN])
    return df.dropna(subset=subset) if subset else df


class CleaningError(ValueError):
    pass


def coerce_types(df: DataFrame, ts_col: str = "timestamp", mode: str = "strict") -> DataFrame:
    """Timestamp -> TIMESTAMP, amount -> DOUBLE (bad text -> NULL),
    target -> INT, ids and categoricals -> STRING.

    ``mode="strict"`` fails the query on unparseable timestamp or target text;
    ``mode="permissive"`` turns them into NULL.
    """
    out = df
    if ts_col in out.columns:
        parsed = F.try_to_timestamp(F.col(ts_col).cast("string"))
        if mode == "strict":
            parsed = F.when(F.col(ts_col).isNull() | parsed.isNotNull(), parsed).otherwise(
                F.raise_error(F.concat(F.lit("unparseable timestamp: "), F.col(ts_col).cast("string"))))
        out = out.withColumn(ts_col, parsed.cast("timestamp"))
    if "amount" in out.columns:
        out = out.withColumn("amount", F.col("amount").try_cast("double"))
    if TARGET_COLUMN in out.columns:
        t = F.col(TARGET_COLUMN).try_cast("double")
        if mode == "strict":
            t = F.when(t.isNotNull(), t).otherwise(
                F.raise_error(F.concat(F.lit("invalid target value: "),
                                       F.coalesce(F.col(TARGET_COLUMN).cast("string"), F.lit("NULL")))))
        out = out.withColumn(TARGET_COLUMN, t.cast("int"))
    for c in _present(out, CATEGORICAL_COLUMNS + [k for k in KEY_COLUMNS if k != "timestamp"]):
        out = out.withColumn(c, F.col(c).cast("string"))
    return out


def standardize_categoricals(df: DataFrame, cols=None) -> DataFrame:
    """Strip surrounding whitespace and lower-case the categorical columns."""
    cols = _present(df, CATEGORICAL_COLUMNS if cols is None else cols)
    out = df
    for c in cols:
        out = out.withColumn(c, X.strip_lower(c))
    return out


def filter_invalid_amounts(df: DataFrame, amount_col: str = "amount") -> DataFrame:
    """Drop rows with amount <= 0; rows with a missing amount are kept."""
    a = F.col(amount_col).try_cast("double")
    return df.where(a.isNull() | (a > 0))


def clean_audit(raw: DataFrame, clean: DataFrame, amount_col: str = "amount") -> DataFrame:
    """before/after counts, duplicate rows, missing cells and invalid amounts
    (the last three measured on the raw table), in one row."""
    missing_cells = sum((F.col(c).isNull().cast("long") for c in raw.columns), F.lit(0).cast("long"))
    raw_stats = raw.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.sum(missing_cells).alias("missing_values"),
        F.count_if(F.col(amount_col).try_cast("double") <= 0).alias("invalid_amounts"))
    distinct_rows = raw.distinct().agg(F.count(F.lit(1))).scalar()
    rows_after = clean.agg(F.count(F.lit(1))).scalar()
    return raw_stats.select(
        "rows_before", rows_after.alias("rows_after"),
        (F.col("rows_before") - distinct_rows).alias("duplicates_removed"),
        F.coalesce("missing_values", F.lit(0)).alias("missing_values"),
        "invalid_amounts",
        F.lit(len(raw.columns)).alias("columns_before"),
        F.lit(len(clean.columns)).alias("columns_after"))


def preprocess_transactions(raw: DataFrame, ts_col: str = "timestamp", mode: str = "strict",
                            materialize: bool = True) -> DataFrame:
    """C1 -> C2 -> C3 -> C5 -> C6 -> C7 -> C8, the reference order.

    Median and mode are taken after de-duplication but before null-key rows are
    dropped and before case folding.  All fill values are statistics of the
    same de-duplicated frame, so they are independent scalar subqueries over
    it and are applied in one projection.  With ``materialize`` the
    de-duplicated frame is written once to the shared checkpoint folder, so the
    full-row de-duplication shuffle runs once instead of once per statistic.
    """
    d = clean_duplicates(raw)
    if materialize:   # one de-duplication shuffle; the statistics then scan single columns
        from txrisk.session import materialize as _materialize
        d = _materialize(d, "dedup")
    fills = median_fills(d, _present(d, NUMERIC_COLUMNS))
    fills.update(mode_fills(d, _present(d, CATEGORICAL_COLUMNS)))
    return (_fill(d, fills)
            .transform(lambda x: drop_null_critical(x, ts_col))
            .transform(lambda x: coerce_types(x, ts_col, mode))
            .transform(standardize_categoricals)
            .transform(filter_invalid_amounts))
