"""Line dedup over the whole corpus by deletion neighbourhoods.

A line is dropped if an equal line, or one within the edit bound, stands earlier in the corpus.
Lines are taken as word sequences (blanks between words do not count). The edit bound is one word
(replaced, inserted or deleted) between two lines of at least ``MIN_NEAR_WORDS`` words each, and
none for shorter ones. "Earlier" is by (doc_id, hash of the text, line number), null ids first;
a line is dropped whether or not the earlier one is dropped itself. Lines without a word stay.

Method: every line has a deletion neighbourhood, the line and the line less any one word, kept as
hashed keys. Equal keys mean candidates:

* replaced word i: both lines less word i are equal, so they share key (variant, i);
* inserted or deleted word: one line equals the other less a word, so keys (variant, 0) and
  (variant, i) meet.

All lines of one (variant, i) are within one edit of each other, so only the earliest of them is
needed: a minimum, combined before the shuffle, instead of pairs. Each drop is then verified on
the words of the two lines. Most lines have no neighbour at all; these are told apart first by a
necessary condition: with one edit, the first or the last half of a line is left as it is, so a
line none of whose halves occurs in another line needs no neighbourhood. This loses nothing.

Equal rows (same id and text) keep the same lines. Null texts stay null, empty texts empty. Other
columns pass through, whatever their names. A line that a third of the corpus repeats is one row
after pre-aggregation; the way back to its copies is a join with separate handling of hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import fresh, join_hot, sift, wide_hash, words, written

MIN_NEAR_WORDS = 8
#: Variants that a task gives out together.
ROWS_AT_ONCE = 200_000


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, no, w) of each line with a word. Blank lines are told by the line alone: a filter on its words
    would be pushed below them with a copy of the split."""
    at = docs.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    parts = F.split("line", r"[\x20\x09-\x0D]+")
    return at.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "th", "no", F.array_remove(parts, "").alias("w"))


def _half_keys(w: Column) -> Column:
    """Hashes of the halves of a line as a line of its own length, and of one word less."""
    n = F.size(w)

    def halves(size: Column) -> list[Column]:
        first = (size / 2).cast("int")
        return [F.xxhash64(size, F.lit(side), part) for side, part in (
            (0, F.slice(w, 1, first)), (1, F.slice(w, n - (size - first) + 1, size - first)))]

    return F.array(*halves(n), *halves(n - 1))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, v, i): the line whole (i = 0) and less its word i, as 128-bit hashes.

    A hash is the exclusive or of hashes of (place, word), so all variants of a line follow from sums
    from its front and from its back: time in proportion to its words."""
    cid, v, i, held = [], [[], []], [], 0

    def flush() -> pa.RecordBatch:
        x, y = (pa.array(np.concatenate(s).view(np.int64)) for s in v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(cid)), pa.StructArray.from_arrays([x, y], ["x", "y"]),
                                           pa.array(np.concatenate(i))], ["cid", "v", "i"])

    for b in batches:
        for c, line in zip(b["cid"].to_pylist(), b["line"].to_pylist()):
            parts = line.split(b" ")
            n = len(parts)
            place = np.arange(n, dtype=np.uint64)
            for side in (0, 1):
                h = np.array([xxhash.xxh3_64_intdigest(p, side) for p in parts], np.uint64)
                here, left = _mix(h, place + np.uint64(1)), _mix(h, place)      # in place; moved up by one
                front = np.concatenate(([np.uint64(0)], np.bitwise_xor.accumulate(here)))
                back = np.concatenate((np.bitwise_xor.accumulate(left[::-1])[::-1], [np.uint64(0)]))
                v[side].append(np.concatenate((front[-1:], front[:-1] ^ back[1:])))
            cid.append(np.full(n + 1, c, np.int64))
            i.append(np.arange(n + 1, dtype=np.int32))
            held += n + 1
            if held >= ROWS_AT_ONCE:
                yield flush()
                cid, v, i, held = [], [[], []], [], 0
    if cid:
        yield flush()


def _mix(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hash of (word hash, place): a round of multiplications and shifts."""
    z = (h ^ (place * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(29))


def _one_edit(a: Column, b: Column) -> Column:
    """Whether word arrays ``a`` and ``b`` are one word edit apart, or equal."""
    same = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False).cast("int")
    after = lambda w, start: F.slice(w, start, F.greatest(F.size(w) - start + 1, F.lit(0)))
    return (same == 0) | (after(a, same + 1) == after(b, same + 1)) | (after(a, same + 1) == after(b, same)) | (
        after(a, same) == after(b, same + 1))


def _near(lines: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """(h): distinct lines that have an earlier line within one edit."""
    halves = lines.filter(F.col("n") >= min_words).select("h", "h64", F.explode("halves").alias("key"))
    shared = halves.groupBy("key").agg(F.min("h64").alias("a"), F.max("h64").alias("b"), F.count("*").alias("rows"))
    shared = written(shared.filter(F.col("a") != F.col("b")).select("key", "rows", F.lit(True).alias("met")), "line-halves")
    total = lines.count() * 4
    some = sift(halves.select("h", "key"), F.col("key"), shared, F.col("key"))
    maybe = written(join_hot(some, shared, "key", total, "rows").filter("met").select("h").distinct(), "line-maybe")
    # where each line that may have a neighbour first stands; ids follow the order of the corpus
    where = sift(lines.select("h", "doc_id", "th", "no"), F.xxhash64("h"), maybe, F.xxhash64("h"))
    first = where.groupBy("h").agg(F.min(F.struct("doc_id", "th", "no")).alias("at"))
    placed = written(first.join(maybe, "h").select("h", "at.*"), "line-candidates")
    ordered = written(placed.orderBy("doc_id", "th", "no").select("*", F.monotonically_increasing_id().alias("cid")),
                      "line-order")
    wanted = written(ordered.groupBy("doc_id", "th").agg(F.collect_list(F.struct("no", "cid", "h")).alias("want")), "line-wanted")
    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["th"] == wanted["th"])
    some = sift(docs, F.xxhash64("doc_id", "th"), wanted, F.xxhash64("doc_id", "th"))
    once = some.join(wanted, same).select(F.split("text", "\n").alias("all"), "want").select(
        F.explode("want").alias("c"), "all").select("c.cid", "c.h", words(F.get("all", F.col("c.no"))).alias("w"))
    cands = written(once.dropDuplicates(["cid"]), "line-words")
    keys = cands.select("cid", F.to_binary(F.array_join("w", " "), F.lit("utf-8")).alias("line")).mapInArrow(
        _variants, "cid long, v struct<x: long, y: long>, i int")
    groups = written(keys.groupBy("v", "i").agg(F.min("cid").alias("m"), F.max("cid").alias("x"), F.count("*").alias("rows")),
                     "line-variants")
    of_v = groups.groupBy("v").agg(F.min(F.when(F.col("i") == 0, F.col("m"))).alias("z"),
                                   F.min(F.when(F.col("i") > 0, F.col("m"))).alias("d"))
    reach = groups.join(of_v, "v").select(
        F.struct("v", "i").alias("key"), "rows", "x",
        F.when(F.col("i") == 0, F.col("d")).otherwise(F.least("m", "z")).alias("keeper"))
    # a group none of whose lines has an earlier partner has no say
    reach = written(reach.filter(F.col("keeper") < F.col("x")).drop("x"), "line-reach")
    total = groups.agg(F.sum("rows")).first()[0] or 0
    some = sift(keys.select("cid", F.struct("v", "i").alias("key")), F.xxhash64("key"), reach, F.xxhash64("key"))
    hits = join_hot(some, reach, "key", total, "rows")
    pairs = hits.filter(F.col("keeper") < F.col("cid")).select("cid", "keeper").distinct()
    mine = cands.select("cid", "h", F.col("w").alias("a"))
    theirs = cands.select(F.col("cid").alias("keeper"), F.col("w").alias("b"))
    return pairs.join(mine, "cid").join(theirs, "keeper").filter(_one_edit(F.col("a"), F.col("b"))).select("h").distinct()


def _without(text: Column, drops: Column) -> Column:
    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, nos in batches:
            out = []
            for t, d in zip(texts.to_pylist(), nos.to_pylist()):
                if t is not None and d:
                    d = set(d)
                    t = "\n".join([x for i, x in enumerate(t.split("\n")) if i not in d])
                out.append(t)
            yield pa.array(out, pa.string())
    return cut(text, drops)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_near_words: int = MIN_NEAR_WORDS) -> tuple[DataFrame, str]:
    """``df`` with its texts free of repeated lines, and a column of the line numbers dropped (from 0,
    null where none is); returns the frame and that column's name."""
    out = fresh(df, "dropped_lines")
    inside = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    docs = inside.select("doc_id", "text", wide_hash(F.col("text")).alias("th"))
    lines = written(_lines(docs).select(
        "doc_id", "th", "no", wide_hash(F.array_join("w", " ")).alias("h"), F.xxhash64("w").alias("h64"), F.size("w").alias("n"),
        F.when(F.size("w") >= min_near_words, _half_keys(F.col("w"))).alias("halves")), "lines")
    first = lines.groupBy("h").agg(F.min(F.struct("doc_id", "th", "no")).alias("at"), F.count("*").alias("rows"))
    near = _near(lines, docs, min_near_words).select("h", F.lit(True).alias("near"))
    # of lines that stand once and have no neighbour nothing is dropped
    told = written(first.filter(F.col("rows") > 1).join(near, "h", "full").withColumn("rows", F.coalesce("rows", F.lit(1))), "line-told")
    total = lines.count()
    some = sift(lines.select("doc_id", "th", "no", "h"), F.xxhash64("h"), told, F.xxhash64("h"))
    marked = join_hot(some, told, "h", total, "rows").filter(F.col("at").isNotNull() | F.col("near"))
    here = F.struct("doc_id", "th", "no")
    gone = marked.filter(F.col("near") | ~here.eqNullSafe(F.col("at")))
    drops = written(gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("no")).alias("_nos")), "line-drops")
    drops = drops.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "_nos")

    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_r"),
                    wide_hash(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_t"))
    joined = own.join(drops, F.col("_r")[id_col].eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th")), "left")
    done = joined.select("_r", "_nos", _without(F.col("_r")[text_col], F.col("_nos")).alias("_new"))
    cols = [F.col("_new").alias(c) if c == text_col else F.col("_r")[c].alias(c) for c in df.columns]
    return done.select(*cols, F.col("_nos").alias(out)), out
