"""Profiling and exploratory aggregates.

Per-column statistics are computed in one aggregate and turned long with
``unpivot``; histograms and densities aggregate per bin / per distinct value
before any per-grid work, so their cost is bounded by the bin count, not by
the row count.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions import expressions as X
from txrisk.operators import stats

HIGH_CARDINALITY_LIMIT = 20
TOP_LOCATIONS = 10
NO_LABEL_ANOMALY_RATE = 0.015
KDE_GRID_SIZE = 200
KDE_CUT = 3.0


def _long(df_one_row: DataFrame, cols, value_name: str) -> DataFrame:
    return df_one_row.unpivot([], [F.col(c).alias(c) for c in cols], "column_name", value_name)


def missing_by_column(df: DataFrame) -> DataFrame:
    """``column_name, n_missing`` for every column, one pass."""
    cols = df.columns
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return _long(agg, cols, "n_missing")


def _as_text(c: str, dtype: str):
    """A value as text that is equal where the values are: instants by number, zeros without a sign."""
    col = F.col(c)
    if dtype == "timestamp":
        return F.unix_micros(col).cast("string")
    if dtype in ("double", "float"):
        return (col + F.lit(0.0)).cast("string")
    if dtype == "binary":
        return F.hex(col)
    return F.to_json(F.struct(col), {"ignoreNullFields": "false"}) if "<" in dtype else col.cast("string")


def _values_long(df: DataFrame) -> DataFrame:
    """(``i`` the column's place, ``v`` its value as text), one narrow row a column and row, nulls left out."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.when(F.col(c).isNotNull(), _as_text(c, t)).alias("v"))
                      for i, (c, t) in enumerate(df.dtypes)])
    return df.select(F.inline(pairs)).where(F.col("v").isNotNull())


def _by_column(counts: DataFrame, cols, value_name: str) -> DataFrame:
    """Counts by column place -> one row per column, 0 where there is none."""
    at = F.coalesce(counts.agg(F.map_from_entries(F.collect_list(F.struct("i", "n")))).scalar(), F.create_map().cast("map<int,bigint>"))
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column_name")) for i, c in enumerate(cols)])
    return (counts.sparkSession.range(1).select(F.inline(names))
            .select("column_name", F.coalesce(F.try_element_at(at, F.col("i")), F.lit(0)).cast("long").alias(value_name)))


SKETCH_BITS = 14


def unique_by_column(df: DataFrame, approx: bool = False) -> DataFrame:
    """``column_name, n_unique`` (distinct non-NULL values).

    One scan makes narrow (column, value) pairs that are reduced to distinct ones in each task before the shuffle.
    With ``approx`` a HyperLogLog sketch a column takes their place (2^14 buckets, about 1 percent; it leaves empty texts
    out, so values go in behind a mark)."""
    pairs = _values_long(df)
    counts = (pairs.groupBy("i").agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.concat(F.lit("="), "v"), F.lit(SKETCH_BITS))).alias("n")) if approx
              else pairs.distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n")))
    return _by_column(counts, df.columns, "n_unique")


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row = count - distinct count."""
    distinct = df.distinct().agg(F.count(F.lit(1))).scalar()
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", (F.col("n_rows") - distinct).alias("n_duplicates"))


def profile_summary(df: DataFrame) -> DataFrame:
    """One row per column: dtype, missing count, plus dataset rows / columns / duplicates."""
    dtypes = dict(df.dtypes)
    miss = missing_by_column(df)
    dup = duplicate_row_count(df)
    dtype_map = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(dtypes[c]))])
    order = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    return miss.select(
        order[F.col("column_name")].alias("position"), "column_name",
        dtype_map[F.col("column_name")].alias("dtype"), "n_missing",
        dup.select("n_rows").scalar().alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        dup.select("n_duplicates").scalar().alias("n_duplicates"))


def constant_columns(df: DataFrame) -> DataFrame:
    """P5: columns with at most one distinct value: their least and greatest are the same, or there is none.
    One aggregate without distinct values."""
    def n_unique(c):
        return F.when(F.min(c) != F.max(c), F.lit(2)).when(F.min(c).isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long")
    agg = df.agg(*[n_unique(c).alias(c) for c in df.columns])
    return _long(agg, df.columns, "n_unique").where(F.col("n_unique") <= 1)


def high_cardinality_columns(df: DataFrame, limit: int = HIGH_CARDINALITY_LIMIT) -> DataFrame:
    """String columns with more than ``limit`` distinct values."""
    cats = [c for c, t in df.dtypes if t == "string"]
    return unique_by_column(df.select(*cats)).where(F.col("n_unique") > limit)


def target_distribution(df: DataFrame, label_col: str = "is_anomaly", by=None) -> DataFrame:
    """Count and percent per class (optionally within ``by`` groups)."""
    by = list(by or [])
    counts = df.groupBy(*by, label_col).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(*by)) if by else F.sum("count").over(Window.partitionBy())
    return counts.withColumn("percent", F.col("count") * 100.0 / total)


def fixed_bin_histogram(df: DataFrame, value_col: str, bins: int = 30, lo=None, hi=None,
                        by=None) -> DataFrame:
    """Equal-width histogram with ``bins`` bins; empty bins are present with 0.

    Range defaults to the column min / max (one aggregate, used as a scalar
    subquery).  The last bin is closed on the right, as in NumPy.
    """
    v = F.col(value_col).cast("double")
    base = df.select(*(by or []), v.alias("_x")).where(F.col("_x").isNotNull())
    rng = base.agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    lo_c = F.lit(float(lo)) if lo is not None else rng.select("lo").scalar()
    hi_c = F.lit(float(hi)) if hi is not None else rng.select("hi").scalar()
    width = (hi_c - lo_c) / F.lit(float(bins))
    idx = F.when(width > 0, F.least(F.floor((F.col("_x") - lo_c) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = (base.where((F.col("_x") >= lo_c) & (F.col("_x") <= hi_c))
              .groupBy(*(by or []), idx.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    spark = df.sparkSession
    if by:   # every group gets all bins, generated per group from the aggregated counts (no join)
        grid = counts.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    else:
        grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = grid.join(counts, (by or []) + ["bin"], "left")
    return out.select(*(by or []), "bin",
                      (lo_c + F.col("bin") * width).alias("bin_lo"),
                      (lo_c + (F.col("bin") + 1) * width).alias("bin_hi"),
                      F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def auto_bin_count(df: DataFrame, value_col: str) -> int:
    """NumPy's ``bins="auto"`` rule (current NumPy): width = min(max(FD, sqrt / 2), Sturges)
    with FD = 2 IQR n^(-1/3), sqrt = range / sqrt(n), Sturges = range / (log2 n + 1);
    bins = ceil(range / width).  Needs one small statistics row (count, min, max and
    the exact quartiles)."""
    q = stats.exact_quantiles(df, value_col, [0.25, 0.75])
    st = df.agg(F.min(value_col).alias("lo"), F.max(value_col).alias("hi")).first()
    qq = q.first()
    if qq is None or st.lo is None:
        return 1
    n, ptp = qq.n, st.hi - st.lo
    if ptp == 0:
        return 1
    sturges = ptp / (math.log2(n) + 1.0)
    fd = 2.0 * (qq.q_1 - qq.q_0) * n ** (-1.0 / 3.0)
    sqrt_w = ptp / math.sqrt(n)
    width = min(max(fd, sqrt_w / 2), sturges)
    return max(1, int(math.ceil(ptp / width)))


def log_amount_histogram(df: DataFrame, amount_col: str = "amount", bins="auto") -> DataFrame:
    """Equal-width histogram of log10(amount + 1); bin count by NumPy's "auto" rule
    (the plotting default), ``"sturges"`` or an explicit number."""
    la = df.select(X.log_amount(amount_col).alias("log_amount")).where(F.col("log_amount").isNotNull())
    if bins == "auto":
        bins = auto_bin_count(la, "log_amount")
    elif bins == "sturges":
        n = la.count()
        bins = max(1, int(math.ceil(math.log2(max(n, 1)))) + 1)
    return fixed_bin_histogram(la, "log_amount", bins=int(bins))


def amount_box_stats(df: DataFrame, value_col: str = "amount", label_col: str = "is_anomaly") -> DataFrame:
    """Per class q1 / median / q3 (exact), whiskers at 1.5 IQR, outlier count."""
    q = stats.exact_quantiles(df, value_col, [0.25, 0.5, 0.75], by=[label_col])
    q = q.select(label_col, "n", F.col("q_0").alias("q1"), F.col("q_1").alias("median"),
                 F.col("q_2").alias("q3"))
    v = F.col(value_col).cast("double")
    j = stats.join_groups(df.select(label_col, v.alias("_x")).where(F.col("_x").isNotNull()), q, [label_col], "_x")
    lo_f = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi_f = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    agg = j.groupBy(label_col, "n", "q1", "median", "q3").agg(
        F.min(F.when(F.col("_x") >= lo_f, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(F.col("_x") <= hi_f, F.col("_x"))).alias("whisker_high"),
        F.count_if((F.col("_x") < lo_f) | (F.col("_x") > hi_f)).alias("n_outliers"))
    return agg.withColumn("iqr", F.col("q3") - F.col("q1"))


def category_frequency(df: DataFrame, col: str = "merchant_category") -> DataFrame:
    """P10: counts per value, most frequent first (ties by value)."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), F.asc(col)))


def one_hot_dummies(df: DataFrame, cols, keep=None, max_levels: int = 1000) -> DataFrame:
    """0/1 indicator per (column, value), no level dropped.

    A wide table has a column a level, so the levels are read first and more than ``max_levels`` are refused;
    ``mlprep.level_table`` and ``mlprep.one_hot_sparse`` are the form without a bound.
    """
    keep = list(keep or [])
    exprs = []
    for c in cols:
        levels = [r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct()
                  .orderBy(c).limit(max_levels + 1).collect()]
        if len(levels) > max_levels:
            raise ValueError(f"{c} has more than {max_levels} levels")
        exprs += [(F.col(c) == F.lit(v)).cast("int").alias(f"{c}_{v}") for v in levels]
    return df.select(*keep, *exprs)


def correlation_matrix(df: DataFrame, cols, digits: int = 9) -> DataFrame:
    """Pearson correlation of every pair of ``cols`` (long form): one aggregate over one triangle, mirrored."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    # columns by place: names made of levels may hold any character, or differ in case only
    num = {c: F.col(f"_{i}").cast("double") for i, c in enumerate(df.columns)}
    df = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    agg = df.agg(F.array(*[F.corr(num[cols[i]], num[cols[j]]) for i, j in pairs]).alias("r"))
    cells = [F.struct(F.lit(cols[x]).alias("col_a"), F.lit(cols[y]).alias("col_b"), F.get("r", F.lit(k)).alias("corr"))
             for k, (i, j) in enumerate(pairs) for x, y in {(i, j), (j, i)}]
    return agg.select(F.inline(F.array(*cells))).select("col_a", "col_b", X.round_half_even("corr", digits).alias("corr"))


def anomaly_rate_by(df: DataFrame, col: str = "device_type", label_col: str = "is_anomaly") -> DataFrame:
    """Mean label x 100 per value of ``col``."""
    return df.groupBy(col).agg((F.avg(label_col) * 100).alias("anomaly_rate"))


def anomaly_rate_top_locations(df: DataFrame, col: str = "location", label_col: str = "is_anomaly",
                               k: int = TOP_LOCATIONS) -> DataFrame:
    """The ``k`` most frequent locations (top-k report), their anomaly rate, highest first."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"),
                                 (F.avg(label_col) * 100).alias("anomaly_rate"))
    top = counts.orderBy(F.desc("n"), F.asc(col)).limit(k)
    return top.select(col, "n", "anomaly_rate").orderBy(F.desc("anomaly_rate"), F.asc(col))


#: Cells a bandwidth, terms of the series and reach in bandwidths of ``density_curve``.
KDE_CELLS, KDE_TERMS, KDE_REACH = 4, 13, 9.0


def density_curve(df: DataFrame, value_col: str, grid_size: int = KDE_GRID_SIZE,
                  cut: float = KDE_CUT, digits: int = 9) -> DataFrame:
    """Gaussian kernel density on an evenly spaced grid (Scott bandwidth).

    Values are binned into cells of a quarter bandwidth; a cell keeps the sums of the first powers of its values'
    distances s from its centre (one aggregate over the rows, a row a cell after it). A grid point t bandwidths from the centre
    then takes exp(-t^2/2) * sum of He_k(t) s^k / k! from each cell within reach, which is the kernel itself as a
    series in Hermite polynomials. With |s| <= 1/8 the terms left out are below (1/8)^13 / sqrt(13!), 3e-17 of
    a kernel's height, and a kernel beyond 9 bandwidths is below 3e-18 of it: the work follows the cells, not the distinct values, and the
    sum is exact to rounding. Fewer than two values, or equal ones, have no bandwidth and give no rows.
    """
    v = F.col(value_col).cast("double")
    base = df.select(v.alias("_x")).where(F.col("_x").isNotNull())
    n_, sd = F.count("_x").cast("double"), F.stddev_samp("_x")
    bw_ = F.when(sd > 0, sd * F.pow(n_, F.lit(-0.2)))
    st = base.agg(n_.alias("n"), bw_.alias("bw"), F.min("_x").alias("mn"), F.max("_x").alias("mx"))
    n, bw, mn, mx = (st.select(c).scalar() for c in ("n", "bw", "mn", "mx"))
    start = mn - F.lit(cut) * bw
    step = (mx + F.lit(cut) * bw - start) / F.lit(float(grid_size - 1))
    width = bw / F.lit(float(KDE_CELLS))
    cell = F.floor((F.col("_x") - mn) / width)
    placed = base.select("_x", cell.alias("_cell")).where(F.col("_cell").isNotNull())
    s = (F.col("_x") - mn - (F.col("_cell") + 0.5) * width) / bw
    powers = [F.lit(1.0)]
    for _ in range(KDE_TERMS - 1):
        powers.append(powers[-1] * F.col("_s"))
    cells = placed.select("_cell", s.alias("_s")).groupBy("_cell").agg(
        F.array(*[F.sum(p / float(math.factorial(k))) for k, p in enumerate(powers)]).alias("_m"))
    cells = cells.select("_m", ((F.col("_cell") + 0.5) * width + mn).alias("_c"), start.alias("_start"), step.alias("_step"), bw.alias("_bw"))
    at = lambda x: (x - F.col("_start")) / F.col("_step")
    first = F.greatest(F.ceil(at(F.col("_c") - KDE_REACH * F.col("_bw"))), F.lit(0))
    last = F.least(F.floor(at(F.col("_c") + KDE_REACH * F.col("_bw"))), F.lit(grid_size - 1))
    near = cells.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("_p"))
    near = near.select("_m", F.col("_p").cast("int").alias("point"), ((F.col("_start") + F.col("_p") * F.col("_step") - F.col("_c")) / F.col("_bw")).alias("_t"))
    # He_0 = 1, He_1 = t, He_(k+1) = t He_k - k He_(k-1)
    t = F.col("_t")
    zero = F.struct(F.lit(0.0).alias("before"), F.lit(1.0).alias("he"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum"))
    series = F.aggregate("_m", zero, lambda a, m: F.struct(a["he"].alias("before"), (t * a["he"] - a["k"] * a["before"]).alias("he"),
                                                           (a["k"] + 1.0).alias("k"), (a["sum"] + a["he"] * m).alias("sum")), lambda a: a["sum"])
    dens = near.groupBy("point").agg(F.sum(F.exp(-t * t / 2) * series).alias("_s"))
    grid = base.sparkSession.range(grid_size).select(F.col("id").cast("int").alias("point")).where(bw.isNotNull())
    norm = F.lit(1.0) / (n * bw * F.sqrt(F.lit(2 * math.pi)))
    return grid.join(dens, "point", "left").select("point", X.round_half_even(start + F.col("point") * step, digits).alias("x"),
                                                   X.round_half_even(F.coalesce("_s", F.lit(0.0)) * norm, digits).alias("density"))


def dataset_kpis(df: DataFrame, label_col: str = "is_anomaly", customer_col: str = "customer_id",
                 amount_col: str = "amount") -> DataFrame:
    """Rows, anomaly rate (0.015 when there is no label), distinct customers, mean amount."""
    rate = F.avg(label_col) if label_col in df.columns else F.lit(NO_LABEL_ANOMALY_RATE)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), rate.cast("double").alias("anomaly_rate"),
                  F.count_distinct(customer_col).alias("n_customers"),
                  F.avg(amount_col).alias("mean_amount"))


def sample_head(df: DataFrame, n: int = 10, order_col: str = "transaction_id") -> DataFrame:
    """The first ``n`` rows by ``order_col`` (a top-k, not a sample of the data)."""
    return df.orderBy(order_col).limit(n)


def crosstab_counts(df: DataFrame, label_col: str, dims) -> DataFrame:
    """Counts by label alone and by each (dimension, label) pair, long form: grouping sets in one scan."""
    dims = list(dims)
    texts = df.select(F.col(label_col).alias("_label"), *[F.col(d).cast("string").alias(f"_d{i}") for i, d in enumerate(dims)])
    cols = [f"_d{i}" for i in range(len(dims))]
    counts = texts.groupingSets([["_label"], *[["_label", c] for c in cols]], "_label", *cols).agg(
        F.count(F.lit(1)).alias("count"), *[F.grouping(c).alias(f"_g{c}") for c in cols])
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d, c in zip(dims, cols):
        own = F.col(f"_g{c}") == 0
        dimension, value = F.when(own, F.lit(d)).otherwise(dimension), F.when(own, F.col(c)).otherwise(value)
    return counts.select(dimension.alias("dimension"), value.alias("value"), F.col("_label").alias(label_col), "count")
