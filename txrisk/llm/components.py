"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import join_hot, written


def _large(links: DataFrame, rows: int) -> DataFrame:
    """Each node ties its greater neighbours to the least node it knows."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
    tied = join_hot(both.filter(F.col("v") > F.col("u")), least, "u", rows, "n", ["u", "v"])
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame, rows: int) -> DataFrame:
    """Each node ties its smaller neighbours, and itself, to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    tied = join_hot(links, least, "u", rows, "n", ["u", "v"]).filter(F.col("v") != F.col("m"))
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def star_components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links`` (two columns of one type): the root is the least node of
    the component. Roots themselves are left out, as are links of a node to itself or to null.

    The centre of a star may hold most links, so both joins deal hot nodes over salts; links are distinct, and a
    round makes no more of them than it read, but for one a node. Rounds grow with the logarithm of a component's size. Each round is written to the shared
    folder, so lineage stays short and lost executors cost one round at most; only two sums of
    each round reach the driver, to see whether anything changed."""
    a, b = links.columns
    now = links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, seen = written(now, "links"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        tied = _large(now, mark[0]).distinct()
        now = written(_small(tied, mark[0]).distinct(), "links")
