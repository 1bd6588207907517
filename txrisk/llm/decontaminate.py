"""Benchmark passages in documents, found by spaced-seed hashing [native].

Words are runs of letters and digits in lower case. A passage is a stretch of ``WINDOW`` = 13 words
of an item of which a document has at least 11 in place: up to two words may be replaced. Shorter
items must occur whole: those of 10 to 12 words with up to one word replaced, those of 4 to 9
unchanged. Items of fewer than ``SHORTEST`` = 4 words are common phrases, no evidence, and never match.

Seeds: two fixed masks over 8 words, each of which looks at 6 of them and ignores two. The masks
were chosen so that whatever two of 13 words are replaced, one of the masks fits somewhere without
touching them, nor one of 10 to 12 (the tests try every case), so no passage is missed. Items of 4 to
7 words are one seed without a mask, of their own length; documents get seeds of those lengths only
that the benchmark has. Masked words are hashed at every
place of every document and item, equal hashes are joined, and around each hit the words themselves
are compared in every window that holds it; hash collisions thus cannot count.

The index of the benchmark is broadcast if it has at most ``BROADCAST_ROWS`` rows, as counted; beyond
that the same join is a shuffled one. Document words are cut out around hits only.

Null and blank texts have no passages. Repeated rows add nothing; items with equal texts are all
reported. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import wide_hash

WINDOW, LEAST = 13, 11
SHORTEST = 4
# The places, out of 8, that each mask looks at.
MASKS = ((0, 1, 4, 5, 6, 7), (0, 1, 2, 4, 6, 7))
SPAN = 8
#: At some 0.3 KB a row, the broadcast stays below 60 MB.
BROADCAST_ROWS = 200_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _least(n: Column) -> Column:
    """The equal words that a window of an item of ``n`` words needs."""
    return F.when(n >= WINDOW, F.lit(LEAST)).when(n >= 10, n - 1).otherwise(n)


def _seeds(df: DataFrame, keys: list[str], short: list[int], own_length: bool = False) -> DataFrame:
    """keys, ``h`` (hash of the words looked at), ``around`` (words about the place), ``at`` (where in ``around`` the
    place is), ``p`` (place) and ``n`` (words in all): a row for each place and mask, and for each place and length of
    ``short``, where ``own_length`` takes the length of the row's words only."""
    cut = df.filter(F.size("w") >= min([SPAN, *short])).select(*keys, "w", F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    placed = cut.select(*keys, "w", "wh", F.explode(F.sequence(F.lit(0), F.size("wh") - min([SPAN, *short]))).alias("p"))
    seed = lambda mark, places: F.xxhash64(F.lit(mark), *[F.get("wh", F.col("p") + i) for i in places])
    left = F.size("wh") - F.col("p")
    hashes = [F.when(left >= SPAN, seed(m, mask)) if short else seed(m, mask) for m, mask in enumerate(MASKS)]
    hashes += [F.when((left == n) & (F.col("p") == 0) if own_length else left >= n, seed(n, range(n))) for n in short]
    side = WINDOW - SPAN
    low = F.greatest(F.col("p") - side, F.lit(0))
    # An explode in generated code passes references to the words on; array_compact would copy them at every place.
    seeds = placed.select(*keys, "w", "p", F.explode(F.array(*hashes)).alias("h"))
    return (seeds.filter(F.col("h").isNotNull()) if short else seeds).select(
        *keys, "h", "p", F.slice("w", low + 1, F.col("p") + WINDOW - low).alias("around"),
        (F.col("p") - low).alias("at"), F.size("w").alias("n"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, equal_words, first_word): each document with a passage of an item, the most
    equal words in a window, and the place of the first such window among the document's words."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), _words(F.col(f"`{item_text_col}`")).alias("w"))
    # One row a length, four at most.
    size = F.size("w")
    short = sorted(r["n"] for r in items.filter((size >= SHORTEST) & (size < SPAN)).select(size.alias("n")).distinct().collect())
    index = _seeds(items, ["item_id"], short, own_length=True).select("h", "item_id", F.col("around").alias("item"), F.col("at").alias("item_at"),
                                              F.col("n").alias("item_n"))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _words(F.col(f"`{text_col}`")).alias("w"))
    seeds = _seeds(texts, ["doc_id"], short).drop("n")
    small = index.count() <= BROADCAST_ROWS
    hits = seeds.join(F.broadcast(index) if small else index, "h")
    left = F.least("at", "item_at")
    lined = hits.select(
        "doc_id", "item_id", "item_n", (F.col("p") - left).alias("start"),
        F.slice("around", F.col("at") - left + 1, WINDOW * 2).alias("a"),
        F.slice("item", F.col("item_at") - left + 1, WINDOW * 2).alias("b"))
    size = F.least(F.lit(WINDOW), "item_n")
    equal = F.zip_with("a", "b", lambda x, y: F.when(x == y, F.lit(1)).otherwise(F.lit(0)))
    counted = lined.select("doc_id", "item_id", "start", size.alias("size"), equal.alias("eq"),
                           F.least(F.size("a"), F.size("b")).alias("len"),
                           _least(F.col("item_n")).alias("least"))
    sums = F.when(F.col("len") >= F.col("size"), F.transform(
        F.sequence(F.lit(0), F.col("len") - F.col("size")),
        lambda s: F.struct(F.aggregate(F.slice("eq", s + 1, F.col("size")), F.lit(0), lambda n, x: n + x).alias("same"),
                           (F.col("start") + s).alias("first"))))
    windows = counted.select("doc_id", "item_id", "least", F.explode(sums).alias("s"))
    return windows.filter(F.col("s.same") >= F.col("least")).groupBy("doc_id", "item_id").agg(
        F.max("s.same").cast("long").alias("equal_words"), F.min("s.first").cast("long").alias("first_word"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a passage of the benchmark in their text, with their columns."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_r"),
                      wide_hash(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_t"))
    keyed = row.select(F.col("_t").alias("k"), F.col("_r")[text_col].alias("text"))
    found = overlaps(keyed, benchmark, "k", "text", item_col, item_text_col).select(F.col("doc_id").alias("_t")).distinct()
    return row.join(found, "_t", "left_anti").select("_r.*")
