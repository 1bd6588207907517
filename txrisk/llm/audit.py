"""Filter interaction audit: what each filter removes, wherever it stands in the chain.

A text is reduced to a mask of the filters it fails, and the corpus to counts per (part, mask): at most
2^m rows a part for m filters. Applying filters one after another is a walk through the lattice of
subsets: state S is the set of filters applied so far, and the edge (S, f) applies f next. An edge removes the
documents that pass all of S and fail f, whatever the order in which S was applied. So the m! orders need
no pass of their own. Orders that reach S and orders that leave it are counted forward and backward over
the lattice; reach(S) * leave(S + f) orders cross the edge (S, f). Removals weighted by that number add up to the
filter's Shapley total, and the step of any one order is read off the edge it crosses.

Defined results: a null text is an empty one; a null part is the empty string. A document is a copy if some other
row has the same text and a smaller id: rows without an id are never copies and make none, rows that share an
id and a text make no copies of each other. Repeated rows count each. Labels: a document has a mark if any label row of its id
has it; labels without an id count for nobody. Empty tables give no rows. Columns beside those named are not
read. Texts of any length are handled in their own task, in time and memory linear in their length.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import let, words, written

#: More filters than this have more orders than one wants to read (7! = 5,040).
MOST_FILTERS = 7
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def few_words(text: Column, w: Column) -> Column:
    return F.size(w) < 200


def repetitive(text: Column, w: Column) -> Column:
    return 100 * F.size(F.array_distinct(w)) < 50 * F.size(w)


def shouting(text: Column, w: Column) -> Column:
    return 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 2 * F.length(text)


def symbols(text: Column, w: Column) -> Column:
    return F.length(F.translate(text, "#$%&*|", "")) < F.length(text)


#: Failure conditions on (text, its words), by the letter that stands for the filter in an order.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {"A": few_words, "B": repetitive, "C": shouting, "D": symbols}
#: The filter that no text can answer alone: the same text under a smaller id. It comes last in a mask.
COPY = "E"


class Lattice:
    """States and edges of ``m`` filters, with the orders that cross each edge.

    ``edges`` holds (state, filter number, crossing orders) and ``names`` the crossing orders by name."""

    def __init__(self, letters: str):
        if not 0 < len(letters) <= MOST_FILTERS:
            raise ValueError(f"between 1 and {MOST_FILTERS} filters can be audited by order")
        m, full = len(letters), (1 << len(letters)) - 1
        reach, leave = [0] * (full + 1), [0] * (full + 1)
        reach[0] = leave[full] = 1
        for s in range(1, full + 1):
            reach[s] = sum(reach[s ^ 1 << f] for f in range(m) if s >> f & 1)
        for s in range(full - 1, -1, -1):
            leave[s] = sum(leave[s | 1 << f] for f in range(m) if not s >> f & 1)
        self.edges = [(s, f, reach[s] * leave[s | 1 << f]) for s in range(full + 1) for f in range(m) if not s >> f & 1]
        self.names: dict[tuple[int, int], list[str]] = {(s, f): [] for s, f, _ in self.edges}
        for order in permutations(range(m)):
            state = 0
            for f in order:
                self.names[state, f].append("".join(letters[g] for g in order))
                state |= 1 << f


def failed_filters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
                   filters: dict[str, Callable[[Column, Column], Column]] = FILTERS) -> DataFrame:
    """(id, part, mask, n): how many rows of an id and part fail just the filters in ``mask``.

    Bit i stands for the i-th of ``filters``, the last bit for copies. Texts are read once and leave as a digest;
    equal rows are added up before they are shuffled, and what follows goes by (digest, id), so that
    many copies of a text are many keys."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    bits = let(words(text), lambda w: sum(
        (F.when(fails(text, w), F.lit(1 << i)).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0)))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("digest"), bits.alias("mask"))
    rows = written(rows.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    named, nameless = rows.filter("id IS NOT NULL"), rows.filter("id IS NULL")
    first = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("first").isNull(), F.lit(1 << len(filters))).otherwise(0)
    return (named.join(first, ["digest", "id"], "left").select("id", "part", F.col("mask").bitwiseOR(copy).alias("mask"), "n")
            .unionByName(nameless.select("id", "part", "mask", "n")))


def mask_counts(failed: DataFrame, labels: DataFrame, marks: dict[str, Column], id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, one count for each of ``marks``): documents by the filters they fail.

    ``marks`` are conditions on label rows; only rows with an id meet labels, so that rows without
    one are not gathered."""
    told = (labels.filter(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id"))
            .agg(*[F.max(F.coalesce(cond, F.lit(False))).alias(m) for m, cond in marks.items()]))
    met = failed.filter("id IS NOT NULL").join(told, "id", "left")
    rest = failed.filter("id IS NULL").select("*", *[F.lit(False).alias(m) for m in marks])
    return met.unionByName(rest).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(m), F.col("n")).otherwise(0)).alias(m) for m in marks])


def edge_counts(counts: DataFrame, lattice: Lattice, marks: list[str]) -> DataFrame:
    """One row per part and lattice edge: kept, removed, redundant, unique_fails, each mark's removals, and ``shapley``."""
    edges = F.array(*[F.struct(F.lit(i).alias("edge"), F.lit(s).alias("state"), F.lit(f).alias("f"), F.lit(1 << f).alias("bit"),
                               F.lit(w).cast("long").alias("weight")) for i, (s, f, w) in enumerate(lattice.edges)])
    e, mask = F.col("e"), F.col("mask")
    fails, before = mask.bitwiseAND(e["bit"]) != 0, mask.bitwiseAND(e["state"]) == 0
    total = lambda cond, of="n": F.sum(F.when(cond, F.col(of)).otherwise(0))
    of_edges = counts.withColumn("e", F.explode(edges)).groupBy("part", "e").agg(
        total(before & ~fails).alias("kept"), total(before & fails).alias("removed"), total(~before & fails).alias("redundant"),
        total(mask == e["bit"]).alias("unique_fails"), *[total(before & fails, m).alias(m) for m in marks])
    shares = of_edges.groupBy("part", e["f"].alias("f")).agg(F.sum(e["weight"] * F.col("removed")).alias("shapley"))
    return of_edges.select("*", e["f"].alias("f")).join(shares, ["part", "f"])


def audit(docs: DataFrame, labels: DataFrame, marks: dict[str, Column],
          filters: dict[str, Callable[[Column, Column], Column]] = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step: what that step keeps and removes, and the filter's Shapley total."""
    letters = "".join(filters) + COPY
    lattice = Lattice(letters)
    counts = written(mask_counts(failed_filters(docs, filters=filters), labels, marks), "audit-masks")
    orders = F.lit([lattice.names[s, f] for s, f, _ in lattice.edges])
    out = edge_counts(counts, lattice, list(marks)).withColumn("filter_order", F.explode(F.get(orders, F.col("e")["edge"])))
    step = (F.bit_count(F.col("e")["state"]) + 1).cast("int").alias("step")
    return out.select("part", "filter_order", step, *[F.col(c).cast("long") for c in (
        "kept", "removed", "redundant", "unique_fails", *marks, "shapley")])
