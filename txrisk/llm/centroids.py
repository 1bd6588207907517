"""Centroid clustering of integer vectors in column expressions alone.

Every vector is an array of integers, written once. A round reads it, measures the squared distance to each
centroid (``zip_with`` over the vector and a literal array, ``aggregate`` over the squares), takes the least (distance,
number) with ``array_min``, and adds the vectors of a cluster up, one sum a component, combined in each
task before anything is shuffled. What comes back to the driver is one row a cluster: k rows of ``dims`` sums, whatever the
corpus. Sums and counts are integers and the quotient is floored exactly, so the result does not
depend on how the rows lie, nor on an executor that is lost.

Defined results: vectors that are null, have another length, or hold a null, NaN or infinite component are left out. Ties go to
the smaller centroid number; rows that share an id are vectors of their own, put in order by their components where
the starting centroids are chosen; a null id is hashed as an empty one. Fewer vectors than centroids: as many centroids as vectors. An
empty table gives no rows. Components beyond +-2^27 are set to that bound, so that a squared distance in 64 dimensions
fits 64 bits; a sum of distances that no 64 bits hold is null. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import written

BOUND = 1 << 27


def to_integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 64) -> DataFrame:
    """(id, v): the whole vectors of ``dims`` components, each as floor(scale * x) in 64 bits."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = df.select(F.col(f"`{id_col}`").alias("id"), x.alias("x")).filter((F.size("x") == dims) & F.forall("x", finite))
    place = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(BOUND))), F.lit(float(-BOUND))))
    return whole.select("id", F.transform("x", place).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``<seed>:<id>``, in that order; each task sends k rows at most."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in vectors.select(draw.alias("draw"), "v").orderBy("draw", "v").limit(k).collect()]


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid, the smaller number on ties."""
    def distance(c):
        squares = F.zip_with(v, F.lit(np.array(c, dtype="int64")), lambda a, b: (a - b) * (a - b))
        return F.aggregate(squares, F.lit(0).cast("long"), lambda total, x: total + x)

    return F.array_min(F.array(*[F.struct(distance(c).alias("distance"), F.lit(i).alias("cluster"))
                                 for i, c in enumerate(centroids)]))


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every centroid at the floored mean of the vectors nearest to it; one without vectors stays."""
    own = vectors.select(nearest(F.col("v"), centroids)["cluster"].alias("cluster"), "v")
    sums = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("v", F.lit(j))).alias(f"s{j}")
                                                                      for j in range(len(centroids[0]))])
    out = list(centroids)
    for r in sums.collect():
        out[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(len(centroids[0]))]
    return out


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1", **shape) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every whole vector after ``rounds`` moves of the centroids, and the centroids."""
    vectors = written(to_integers(df, **shape), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    best = vectors.select("id", nearest(F.col("v"), centroids).alias("best"))
    return written(best.select("id", "best.cluster", "best.distance"), "clusters"), centroids


def with_inertia(assigned: DataFrame, k: int) -> DataFrame:
    """``assigned`` with the sum of distances of its cluster and of all; k sums pass through the driver."""
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    whole = None if None in sums.values() or sum(sums.values()) >= 1 << 63 else sum(sums.values())
    of = F.array(*[F.lit(sums.get(i)).cast("long") for i in range(max(k, 1))])
    return assigned.select("*", F.get(of, F.col("cluster")).alias("cluster_inertia"), F.lit(whole).cast("long").alias("inertia"))
