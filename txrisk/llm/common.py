"""Helpers shared by the text operators: words, names, shared folders, joins on hot keys."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.session import ensure_checkpoint_dir

#: White space that ends a word: blank and the five controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: A key that holds more than one row in this many is dealt over salts: at most that many keys can.
HOT_SHARE = 2000
SIFT_BITS = 26


def words(text: Column) -> Column:
    """Array of the maximal runs of non-blank characters; null and blank texts give an empty array."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, r"[\x20\x09-\x0D]+"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often the body names it; inside the
    body an array stays an object in memory, so element access costs no copy."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z (and only those) in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def wide_hash(value: Column) -> Column:
    """16 bytes that stand for a string; collisions are out of reach at any corpus size."""
    return F.unhex(F.md5(value))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder all executors share (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later passes neither recompute it
    nor depend on an executor that may go."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sift(big: DataFrame, hash_of: Column, small: DataFrame, small_hash: Column) -> DataFrame:
    """The rows of ``big`` whose hash may be among those of ``small``: all that are, and few others.

    The hashes of ``small``, a stored table, are laid into a bit map of 2^``SIFT_BITS`` places, so that rows
    without a partner need not be shuffled. A row of the map holds eight longs of places; at most 2^17 such
    rows, some 15 MB, are broadcast whatever the size of ``small``. With more rows than places the map would let most
    pass, and ``big`` is returned as it is; a join must follow either way."""
    if small.count() > 1 << SIFT_BITS:
        return big
    place = lambda h: F.pmod(h, F.lit(1 << SIFT_BITS))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63).cast("int"))
    which = lambda p: F.shiftright(p, 6).bitwiseAND(7)
    at = small.select(place(small_hash).alias("p"))
    marks = at.groupBy(F.shiftright("p", 9).alias("_w")).agg(
        *[F.bit_or(F.when(which(F.col("p")) == j, bit(F.col("p")))).alias(f"_m{j}") for j in range(8)])
    put = big.withColumn("_p", place(hash_of))
    met = put.join(F.broadcast(marks), F.shiftright("_p", 9) == F.col("_w"))
    mark = reduce(lambda c, j: c.when(which(F.col("_p")) == j, F.col(f"_m{j}")), range(8), F)
    return met.filter(mark.bitwiseAND(bit(F.col("_p"))) != 0).select(*big.columns)


def join_hot(big: DataFrame, small: DataFrame, key: str, rows: int, count: str, deal: list[str] | None = None) -> DataFrame:
    """Left join of ``big`` to ``small`` (one row a key) where a few keys may hold most rows.

    ``small[count]`` is the number of rows of ``big`` with that key and ``rows`` the number of rows
    in all. A key with more than one row in ``HOT_SHARE`` is dealt over as many salts as it has such
    shares; its row in ``small`` is repeated for each, which makes fewer than ``HOT_SHARE`` repeats
    in all. Only keys and numbers of salts are broadcast, for fewer than ``HOT_SHARE`` keys by
    arithmetic. The salt follows from the row and its place in the input, so that equal rows are dealt too; ``big`` is to
    be a stored table, or made from one row by row, so that a task that runs again deals alike. Where ``deal``
    names columns that tell the rows of a key apart, the salt follows from those alone and ``big`` may come from
    a shuffle. Null keys have no partner. Returns the columns of ``big`` and those of ``small`` but for key and count.
    """
    least = max(rows // HOT_SHARE, 1)
    rest = [c for c in small.columns if c not in (key, count)]
    salts = F.ceil(F.col(count) / F.lit(least)).cast("int")
    hot = small.filter(F.col(count) > least).select(key, salts.alias("_salts"))
    mark = F.xxhash64(*deal) if deal else F.xxhash64(F.monotonically_increasing_id(), *[F.col(c) for c in big.columns])
    dealt = big.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(mark, F.when(
        F.col(key).isNull(), F.lit(HOT_SHARE)).otherwise(F.coalesce("_salts", F.lit(1)))).cast("int"))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return dealt.join(spread.select(key, "_salt", *rest), [key, "_salt"], "left").select(*big.columns, *rest)
