"""Filter audit, centroids and sharding against plain code, and what the shard files promise."""
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from txrisk.llm import audit, centroids, sharding
from txrisk.llm.queries import QUERIES


def read(folder, table):
    return pq.read_table(f"{folder}/{table}.parquet").to_pylist()


def test_lattice_counts_orders():
    for m in range(1, 6):
        lattice = audit.Lattice("ABCDE"[:m])
        assert all(w == len(lattice.names[s, f]) for s, f, w in lattice.edges)
        for f in range(m):      # every order crosses one edge of every filter
            assert sum(w for s, g, w in lattice.edges if g == f) == math.factorial(m)
    with pytest.raises(ValueError):
        audit.Lattice("ABCDEFGH")


def test_audit_as_brute_force(spark, awkward):
    docs, labels = read(awkward, "documents"), read(awkward, "labels")
    marks = {k: {r["doc_id"] for r in labels if r[k] == 1 and r["doc_id"] is not None} for k in ("quality", "toxic")}
    rows = []
    for d in docs:
        x = d["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        copy = d["doc_id"] is not None and any((o["text"] or "") == x and o["doc_id"] is not None and o["doc_id"] < d["doc_id"] for o in docs)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", x)) > 2 * len(x),
                 "D": bool(re.search(r"[#$%&*|]", x)), "E": copy}
        rows.append((d["source"] or "", {k for k, v in fails.items() if v}, d["doc_id"] in marks["quality"], d["doc_id"] in marks["toxic"]))
    want = {}
    for part in {r[0] for r in rows}:
        shapley, steps = Counter(), {}
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for i, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                again = sum(r[0] == part and f in r[1] for r in rows) - len(gone)
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                steps["".join(order), i + 1] = (f, len(left), len(gone), again, sum(r[0] == part and r[1] == {f} for r in rows),
                                                sum(r[2] for r in gone), sum(r[3] for r in gone))
        want |= {(part, *k): (*v[1:], shapley[v[0]]) for k, v in steps.items()}
    got = {tuple(r)[:3]: tuple(r)[3:] for r in QUERIES["op11_filter_audit"](spark, awkward).collect()}
    assert got == want


def test_centroids_as_brute_force(spark, awkward):
    rows = [(r["vec_id"], r["embedding"]) for r in read(awkward, "embeddings")]
    top = float(centroids.BOUND)
    kept = [(i, [math.floor(max(min(64 * x, top), -top)) for x in e]) for i, e in rows
            if e and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    draw = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    cs = [v for _, v in sorted((draw(i), v) for i, v in kept)[:16]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((far(v, c), k) for k, c in enumerate(cs))
    for _ in range(3):
        own = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), k in zip(kept, own) if k == j] for j in range(len(cs))]
        cs = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, cs)]
    best = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, k in best:
        inertia[k] += d
    want = [(i, k, d, inertia[k], inertia.total(), hashlib.sha256(",".join(map(str, cs[k])).encode()).hexdigest()) for i, d, k in best]
    got = [tuple(r) for r in QUERIES["op12_centroids"](spark, awkward).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    side = range(1 << bits)
    cells = spark.createDataFrame([list(c) for c in itertools.product(side, repeat=dims)], [f"x{j}" for j in range(dims)])
    at = cells.select(sharding.curve_index([F.col(f"x{j}").cast("int") for j in range(dims)], bits).alias("h"), "*").collect()
    path = [tuple(r)[1:] for r in sorted(at)]
    assert [r["h"] for r in sorted(at)] == list(range(len(at)))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))


def test_shards_of_awkward_documents(spark, awkward):
    docs = read(awkward, "documents")
    got = QUERIES["op13_hilbert_shards"](spark, awkward).collect()
    text = lambda d: (d["text"] or "").encode()
    assert (sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr)
            == sorted(((d["doc_id"], len(text(d)) + 1, zlib.crc32(text(d))) for d in docs), key=repr))
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))


def test_shard_files_give_back_rows(spark, awkward, tmp_path):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, sharding.document_dims(docs), shards=5)
    everything = sorted(map(tuple, docs.collect()), key=repr)
    parts = [sharding.read_shard(spark, path, s) for s in range(6)]
    assert sorted((tuple(r) for p in parts for r in p.collect()), key=repr) == everything
    assert parts[0].columns == docs.columns and parts[5].count() == 0
    few = docs.limit(3)
    sharding.write_shards(few, f"{path}-few", sharding.document_dims(few), shards=8)
    assert sorted(r["shard"] for r in sharding.read_placed(spark, f"{path}-few").collect()) == [0, 2, 5]


def test_pruning_reads_bins(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, sharding.document_dims(docs))
    wanted = spark.range(1).select(sharding.value_bin(F.lit("src0"))).first()[0]
    found = sharding.read_where(spark, path, source=wanted)
    assert found.filter("source = 'src0'").count() == docs.filter("source = 'src0'").count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(bin_source" in plan


def test_one_text_and_id_for_most_rows_is_spread(spark, tmp_path):
    same = spark.range(9000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    path = str(tmp_path / "hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sharding.write_shards(same.repartition(4), path, sharding.document_dims(same))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    runs = spark.read.parquet(f"{path}/runs").collect()
    assert len(runs) > 4 and max(r["n"] for r in runs) < 9000 / 3
    assert Counter(r["shard"] for r in sharding.read_placed(spark, path).collect()) == {s: 1125 for s in range(8)}
