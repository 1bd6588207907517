"""Sharding along a Hilbert curve [native].

Several metadata dimensions are quantised to ``bits`` bits each and the cell is numbered along a Hilbert curve, so
rows that are near in all dimensions are near in the order. Rows are put in order of (curve index, text digest, id) by
one range exchange and written once as files that are runs of the curve. Spark's own statistics of each
file and row group then prune on every dimension (``read_where``). Row numbers follow from a count per
written partition, and shards are cut from the order by row number: counts differ by one at most.

Hot cells and copies are no hot tasks: the exchange goes by the whole key and last by the row's place in the input, which
splits even a third of all rows with one text and one id. The order's last part decides only between rows that
are equal in all that is returned.

The curve is followed by a table: in each of dims * 2^dims orientations, which digit a corner gets and which
orientation is inside it. The table is derived from the Gray code (entry point and direction of each
sub-cube), and one ``aggregate`` over the levels looks it up; no user function is called.

Defined results: a null text counts as an empty one for size and digest; null metadata values have a bin of their own rule (as
any other value); null ids come first; repeated rows are rows of their own; an empty table gives no rows. All columns are kept
whatever their names; the written names of this module avoid them. Very long texts pass once through the exchange as whole rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.llm.common import fresh, wide_hash

BITS = 5
#: Spark puts the partition number above this bit of ``monotonically_increasing_id``.
RUN_BIT = 33


def curve_table(dims: int) -> tuple[list[int], list[int]]:
    """(digit, next orientation) for orientation * 2^dims + corner, in order.

    An orientation is (entry corner, main axis). A corner is mapped to the standard position by a mask and a rotation,
    its digit is its place in the Gray code, and the sub-cube's entry and axis follow from that digit."""
    size = 1 << dims
    turn = lambda x, by: (x << by % dims | x >> dims - by % dims) & (size - 1)
    gray = [i ^ i >> 1 for i in range(size)]
    entry = [gray[2 * ((i - 1) // 2)] if i else 0 for i in range(size)]
    ones = lambda i: ((i ^ i + 1).bit_length() - 1)  # set bits at the low end
    axis = [0 if not i else ones(i - 1 + i % 2) % dims for i in range(size)]
    digits, inner = [], []
    for e in range(size):
        for d in range(dims):
            for corner in range(size):
                w = gray.index(turn(corner ^ e, dims - (d + 1) % dims))
                digits.append(w)
                inner.append((e ^ turn(entry[w], d + 1)) * dims + (d + axis[w] + 1) % dims)
    return digits, inner


def curve_index(bins: list[Column], bits: int = BITS) -> Column:
    """Place along the Hilbert curve of a cell given by one integer of ``bits`` bits a dimension."""
    digits, inner = curve_table(len(bins))
    wide = 1 << len(bins)
    corners = F.array(*[sum((F.shiftright(b, level).bitwiseAND(1) * (1 << j) for j, b in enumerate(bins)), F.lit(0))
                        for level in reversed(range(bits))])
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("o"))

    def step(a, corner):
        at = a["o"] * wide + corner
        return F.struct((a["h"] * wide + F.get(F.lit(digits), at)).alias("h"), F.get(F.lit(inner), at).alias("o"))

    return F.aggregate(corners, start, step, lambda a: a["h"])


def value_bin(value: Column, bits: int = BITS) -> Column:
    """Bin of a categorical value by the first byte of its MD5; null is a value like any other."""
    text = F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 2), 16, 10).cast("int") % (1 << bits)


def size_bin(size: Column, bits: int = BITS) -> Column:
    """Bin of a positive number: its binary length less one, exact for every integer."""
    return F.least(F.length(F.bin(size)) - 1, F.lit((1 << bits) - 1))


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text and its end."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def document_dims(df: DataFrame) -> dict[str, Column]:
    """The dimensions of ``documents``: language, source and size."""
    return {"lang": value_bin(F.col("lang")), "source": value_bin(F.col("source")), "size": size_bin(text_size(F.col("text")))}


def write_shards(df: DataFrame, path: str, dims: dict[str, Column], shards: int = 8, id_col: str = "doc_id",
                 text_col: str = "text", bits: int = BITS) -> None:
    """Writes ``df`` along the curve: ``path/rows`` has the columns of ``df`` in a struct ``row``, one ``bin_`` column a dimension, the
    text's ``size`` and ``crc32`` and the place ``at``; ``path/runs`` has each file's rows before it and ``path/cuts`` each shard's first place."""
    spark, text = df.sparkSession, F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    place = fresh(df, "place")
    rows = df.withColumn(place, F.monotonically_increasing_id()).select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[b.alias(f"bin_{n}") for n, b in dims.items()],
        F.col(f"`{id_col}`").alias("id"), text_size(text).alias("size"), F.crc32(text).alias("crc32"),
        wide_hash(text).alias("digest"), F.col(place).alias("place"))
    names = [f"bin_{n}" for n in dims]
    rows = rows.withColumn("curve", curve_index([F.col(n) for n in names], bits))
    order = ["curve", "digest", "id", "place"]
    runs = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    runs.select("row", *names, "curve", "id", "size", "crc32", F.monotonically_increasing_id().alias("at")).write.parquet(f"{path}/rows")
    counts = spark.read.parquet(f"{path}/rows").groupBy(F.shiftright("at", RUN_BIT).alias("run")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    by_run = Window.orderBy("run")                               # one row a written file
    counts.select("*", (F.sum("n").over(by_run) - F.col("n")).alias("before"),
                  F.sum("n").over(Window.partitionBy()).alias("total")).write.parquet(f"{path}/runs")
    # the first row of shard s is row ceil(s * total / shards); it lies in the run that spans it
    cut = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    cuts = spark.read.parquet(f"{path}/runs").select("*", cut).withColumn("first", first).filter("first >= before AND first < before + n")
    cuts.select("shard", "first", (F.shiftleft(F.col("run"), RUN_BIT) + F.col("first") - F.col("before")).alias("at")).coalesce(1).write.parquet(f"{path}/cuts")


def read_placed(spark: SparkSession, path: str) -> DataFrame:
    """All written rows with their ``shard`` and ``slot`` (gapless from 0 in each shard), read back from the files.

    Broadcast are one row a written file (rows before it) and one a shard: by count, not by data."""
    rows, runs = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/runs").select("run", "before")
    cuts = [(r["at"], r["first"], r["shard"]) for r in spark.read.parquet(f"{path}/cuts").orderBy("at", "shard").collect()]
    shard, first = F.lit(0), F.lit(0).cast("long")
    for at, start, number in cuts:
        shard = F.when(F.col("at") >= at, F.lit(number)).otherwise(shard)
        first = F.when(F.col("at") >= at, F.lit(start)).otherwise(first)
    met = rows.withColumn("run", F.shiftright("at", RUN_BIT)).join(F.broadcast(runs), "run")
    within = F.col("at").bitwiseAND((1 << RUN_BIT) - 1)
    return met.select(*rows.columns, shard.cast("int").alias("shard"), (F.col("before") + within - first).alias("slot"))


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """The rows of one shard as they came in; files outside its range of the curve are not read."""
    cuts = {r["shard"]: r["at"] for r in spark.read.parquet(f"{path}/cuts").collect()}
    rows = spark.read.parquet(f"{path}/rows")
    later = [at for s, at in cuts.items() if s > shard]
    if shard not in cuts:
        return rows.filter(F.lit(False)).select("row.*")
    own = rows.filter(F.col("at") >= cuts[shard])
    return (own.filter(F.col("at") < min(later)) if later else own).select("row.*")


def read_where(spark: SparkSession, path: str, **bins: int) -> DataFrame:
    """The rows whose dimensions lie in the given bins; the bins are compared with the statistics of files and row groups
    before a text is read. The caller still compares values where several share a bin."""
    rows = spark.read.parquet(f"{path}/rows")
    for name, b in bins.items():
        rows = rows.filter(F.col(f"bin_{name}") == b)
    return rows.select("row.*")
