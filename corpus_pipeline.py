"""A training corpus from raw documents, in five stages.

Each stage takes what the one before kept, as a Parquet table, and its decisions take effect: rejected
documents go, repeated lines leave their texts, one document of each near-duplicate group
stays, documents with benchmark passages go, and what is left is tokenised.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm import bpe, decontaminate, linededup, quality, simhash
from txrisk.llm.common import shared_path, wide_hash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass every quality rule."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that stand earlier in the corpus (up to one word); ``n_chars`` follows."""
    done, _ = linededup.dedup_lines(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the least id; of equal rows one."""
    key = wide_hash(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    rows = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = rows.select(F.struct(F.col("row.doc_id").isNull().alias("no_id"), "row.doc_id", "key").alias("id"), "row.text")
    found = simhash.near_duplicates(named, "id", "text", simhash.SHINGLE, simhash.MAX_BITS)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select("component_id.key").distinct()
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; ``round_trip`` tells whether they decode to its text."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded, ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, pattern)
    back, raw = bpe.decode(coded, path, pattern, ids)
    return back.select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_tokens"), F.col(ids).alias("token_ids"),
                       (F.col(raw) == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Fingerprint hashes and tokens are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None
