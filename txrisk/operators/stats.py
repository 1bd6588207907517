"""Distributed exact statistics shared by several operators.

``exact_quantiles`` returns exact linear-interpolation quantiles (the pandas /
DuckDB ``quantile_cont`` definition) by selection digit by digit, in the same way at every size.  A
round counts the rows of each group per digit (one of at most 65,536 places that never
fall as values grow) with their least and greatest value, a running count finds the places that hold the wanted
ranks, and the next round looks only inside those.  The first digit is a sixteenth of an octave, two more split
that span into equal steps, and the last round counts the values themselves; a span of one value is done before. What
is gathered for a group is at most 65,536 counted places (2^17 or so values in the last round), whatever
the number of rows, ties or the shape of the distribution; only among numbers below 2^-1000 can there be more.

``modes`` returns the most frequent value with ties going to the smallest,
from a partial-aggregated value count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.session import materialize

#: Tasks over which one group's rows are dealt where small per-group facts are joined to them.
SALTS = 32


def join_groups(big: DataFrame, small: DataFrame, by, value_col: str, salts: int = SALTS) -> DataFrame:
    """Inner join of rows to the few rows of their group, dealt over ``salts`` tasks a group by value."""
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(value_col), F.lit(salts)))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return dealt.join(spread, [*by, "_salt"]).drop("_salt")


#: Digits of a value: the first is a step of 1/16 octave (and the sign), each further one 1/65,536 of the span before.
DIGIT = 65_536
#: Rows that may be broadcast; the caller counts them, and more are joined by salted keys.
BROADCAST_ROWS = 100_000


def _first_digit(v):
    """A place on a logarithmic scale that never falls as ``v`` grows: at most 65,536 places for all doubles.

    Only order matters, so rounding does no harm. Infinities and NaN, the greatest value, have places of their own."""
    size, tiny = F.abs(v), 2.0 ** -1000
    octave = F.when(size < tiny, size / tiny).otherwise(F.greatest(F.lit(1.0), F.least(F.log2(size) + 1001.0, F.lit(2040.0))))
    place = F.floor(octave * 16)
    return F.when(F.isnan(v), F.lit(DIGIT)).when(v < 0, -place).otherwise(place)


def _next_digit(v, lo, hi):
    """A place in ``DIGIT`` equal steps from ``lo`` to ``hi`` that never falls as ``v`` grows."""
    return F.when(lo == hi, F.lit(0)).otherwise(F.least(F.floor((v - lo) / (hi - lo) * DIGIT), F.lit(DIGIT - 1)))


def _holding(counts: DataFrame, by, place, before) -> DataFrame:
    """Of value spans (``lo``, ``hi``, ``c`` rows, in order of ``place`` within ``by``), those that hold a wanted rank."""
    w = Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    at = counts.withColumn("_before", before + F.sum("_c").over(w) - F.col("_c"))
    mine = F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")))
    return at.withColumn("_ranks", mine).where(F.size("_ranks") > 0)


def _rows_of(base: DataFrame, spans: DataFrame, by) -> DataFrame:
    """The rows of ``base`` that lie in one of their group's open spans."""
    few = spans.count() <= BROADCAST_ROWS
    met = base.join(F.broadcast(spans), by) if few else join_groups(base, spans, by, "_v")
    return met.where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def exact_quantiles(df: DataFrame, value_col: str, probs, by=None, prefix: str = "q") -> DataFrame:
    """One row per group: ``n`` and ``{prefix}_{i}`` = exact quantile ``probs[i]``.

    NULLs are ignored, NaN is the greatest value, groups without values are absent.  The values are written once,
    narrow; then every round is one counting aggregate (see the module's text).
    """
    groups, probs, by = list(by or []), [float(p) for p in probs], ["_g"]
    # the group as one struct, in which nulls are equal
    base = df.select(F.struct(*(groups or [F.lit(0).alias("_none")])).alias("_g"), F.col(value_col).cast("double").alias("_v"))
    base = materialize(base.where(F.col("_v").isNotNull()), "quantile-values")
    spans = [F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_c")]
    # round 1: octaves; the ranks follow from the group's number of rows
    counts = base.groupBy(*by, _first_digit(F.col("_v")).alias("_p")).agg(*spans)
    counts = counts.withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    last = F.col("_n") - 1
    ranks = [r for p in probs for r in (F.floor(last * F.lit(p)), F.least(F.floor(last * F.lit(p)) + 1, last))]
    counts = counts.withColumn("_ranks", F.array_distinct(F.array(*ranks)))
    found, keep = None, [*by, "_lo", "_hi", "_n", "_before", "_ranks"]
    state = materialize(_holding(counts, by, "_p", F.lit(0)).select(*keep), "quantile-spans")
    for turn in range(3):
        done = state.where(F.col("_lo") == F.col("_hi"))
        found = done if found is None else found.unionByName(done)
        state = state.where(F.col("_lo") != F.col("_hi"))
        if state.isEmpty():
            break
        rows = _rows_of(base, state, by)
        # rounds 2 and 3: steps of the span; round 4: the values themselves, at most some 2^17 a span by then
        digit = _next_digit(F.col("_v"), F.col("_lo"), F.col("_hi")) if turn < 2 else F.col("_v")
        key = [*by, "_lo"]
        inside = rows.groupBy(*key, "_n", "_before", "_ranks", digit.alias("_p")).agg(
            F.min("_v").alias("_l"), F.max("_v").alias("_h"), F.count(F.lit(1)).alias("_c"))
        held = _holding(inside.withColumnRenamed("_before", "_b"), key, "_p", F.col("_b"))
        state = materialize(held.drop("_lo", "_hi").withColumnsRenamed({"_l": "_lo", "_h": "_hi"}).select(*keep), "quantile-spans")
    else:
        found = found.unionByName(state)
    values = found.groupBy(*by, "_n").agg(F.map_from_entries(F.flatten(F.collect_list(
        F.transform("_ranks", lambda r: F.struct(r.alias("r"), F.col("_lo").alias("v")))))).alias("_at"))
    out = [F.col("_n").alias("n")]
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1).cast("double") * F.lit(p)
        low = F.try_element_at("_at", F.floor(h))
        high = F.try_element_at("_at", F.least(F.floor(h) + 1, F.col("_n") - 1))
        out.append((low + (high - low) * (h - F.floor(h))).alias(f"{prefix}_{i}"))
    return values.select(*[F.col("_g")[g].alias(g) for g in groups], *out)


def exact_median(df: DataFrame, value_col: str, by=None) -> DataFrame:
    q = exact_quantiles(df, value_col, [0.5], by=by)
    return q.withColumnRenamed("q_0", "median")


def modes(df: DataFrame, cols, by=None) -> DataFrame:
    """Long frame ``(column, mode)``: most frequent non-NULL value, ties -> smallest.

    Value counts are partial-aggregated before the shuffle; the arg-max is a
    second aggregate over the (value, count) table of each column.
    """
    by = list(by or [])
    parts = []
    for c in cols:
        counts = (df.where(F.col(c).isNotNull()).groupBy(*by, F.col(c).cast("string").alias("_val"))
                  .agg(F.count(F.lit(1)).alias("_cnt")))
        best = counts.groupBy(*by).agg(
            F.min_by("_val", F.struct(-F.col("_cnt"), F.col("_val"))).alias("mode"))
        parts.append(best.select(*by, F.lit(c).alias("column"), "mode"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def modes_map(df: DataFrame, cols):
    """Modes of several columns in one pass, as one map-valued scalar subquery.

    Each row contributes one (column, value) pair per column; the pairs are
    counted with a partial (map-side) aggregate, the arg-max is taken per
    column, and the result is a single ``map<column, mode>`` value.  Columns
    with no values are absent from the map.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in cols])
    return modes_of_counts(df.select(F.inline(pairs)).where(F.col("v").isNotNull())
                             .groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")))


def modes_of_counts(counts):
    """Modes from (k, v, n) counts, which may come in several parts; ties go to the smallest value."""
    counts = counts.groupBy("k", "v").agg(F.sum("n").alias("_cnt"))
    best = counts.groupBy("k").agg(F.min_by("v", F.struct(-F.col("_cnt"), F.col("v"))).alias("mode"))
    return best.agg(F.map_from_entries(F.collect_list(F.struct("k", "mode")))).scalar()


#: Spark puts the partition number above this bit of ``monotonically_increasing_id``.
PART_BIT = 33


def numbered(df: DataFrame, order, name: str) -> DataFrame:
    """``df`` with a gapless number from 0 in the order of the columns ``order``, without a window over all rows.

    A range exchange on ``order`` is written once, sorted inside each part; a row's number is its place in its
    part plus the rows of earlier parts, one counted row a part."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    parts = materialize(parts, "numbered")
    counts = parts.groupBy(F.shiftright("_at", PART_BIT).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << PART_BIT) - 1)
    return parts.withColumn("_part", F.shiftright("_at", PART_BIT)).join(F.broadcast(before), "_part").select(*df.columns, place.alias(name))
