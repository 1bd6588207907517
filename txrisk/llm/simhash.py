"""Near-duplicate documents by SimHash, found with anchor points of a covering code.

Fingerprint: bit j of 64 is set if it is set in more than half of the XXH64 hashes (seed 42) of the
word shingles. Two documents link if their fingerprints differ in at most ``MAX_BITS`` = 3 bits.

Covering: the fingerprint is cut into two halves. Of 3 differing bits at most one falls into one
of them, so linked fingerprints agree in some half up to one bit. The anchors of a half are the
code words of the perfect Hamming code on 31 of its bits: every value lies within one bit (the
covering radius) of exactly one anchor, its home. Each fingerprint is put at its home and at every
anchor within radius plus one bit, so that two values one bit apart always meet at the home of
either. At each anchor the members are compared by all 64 bits.

Equal fingerprints are one member from the start. An anchor with more members than ``CROWD`` is cut
further: the other half falls into p pieces, 3 differing bits leave p - 3 of them alone, so members go to
one list for each choice of p - 3 pieces, by their values, and links within the lists are the same links.
More members take more pieces (``CUTS``): 8, 16 or 20 bits name a list. A list is read
as a stream of sorted rows and only holds its own members (16 bytes each); the search marks what
it has reached and compares only with the rest, so a dense crowd costs about one comparison a
member. A list yields one link a member at most, not the pairs. Links are then reduced to
components by alternating star contraction on links alone; texts never move again.

Null and blank texts have fingerprint zero and link like any other. Equal rows have equal
results. A null ``doc_id`` never becomes the name of a component unless it has no other member.
Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import join_hot, written
from txrisk.llm.components import star_components

MAX_BITS = 3
SHINGLE = 3
#: Members beyond which an anchor is cut into lists.
CROWD = 4096
#: (multiple of ``CROWD`` beyond which it applies, pieces of the other half).
CUTS = ((1, 4), (16, 6), (256, 8))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one text."""
    parts = text.lower().split()   # on bytes: A-Z and the six blanks, nothing else
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(p) + 1 for p in parts]).tolist()
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b - 1], 42) for a, b in zip(starts, ends[shingle - 1:])]
    h = np.array(hashes, "<u8")
    # how often each byte value stands at each of the 8 places, then bits by value
    seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


_PLACES = (np.arange(8) * 256).astype(np.int64)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """SimHash of a text as a signed long (the bits of the unsigned value)."""
    @F.arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out = np.array([fingerprint(t, shingle) if t else 0 for t in b.to_pylist()], np.uint64)
            yield pa.array(out.view(np.int64))
    return prints(text.cast("binary"))


def _syndrome(half: Column) -> Column:
    """Position (1 to 31) of the bit that leads from the low 31 bits to their code word; 0 if none."""
    # bit i of the syndrome: parity over the places whose number has bit i
    masks = [sum(1 << (n - 1) for n in range(1, 32) if n >> i & 1) for i in range(5)]
    parts = [F.shiftleft((F.bit_count(half.bitwiseAND(F.lit(m))) % 2).cast("int"), i) for i, m in enumerate(masks)]
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def _flip(value: Column, place: Column) -> Column:
    """``value`` with bit ``place`` (from 1; 0: none) of its low 31 turned over."""
    return value.bitwiseXOR(F.when(place > 0, F.call_function("shiftleft", F.lit(1).cast("long"), place - 1))
                            .otherwise(F.lit(0).cast("long")))


def _anchors(half: Column) -> Column:
    """The home anchor of a half first, then every other anchor within two bits."""
    s = _syndrome(half)
    home = _flip(half, s)
    # two flips a, b lead to a code word exactly if a XOR b is the syndrome; a < b counts each once.
    # From a code word itself (s = 0) two flips never lead to another.
    others = F.transform(F.filter(F.sequence(F.lit(1), F.lit(31)),
                                  lambda a: (s > 0) & (a.bitwiseXOR(s) > a)),
                         lambda a: _flip(_flip(half, a), a.bitwiseXOR(s)))
    return F.concat(F.array(home), others)


def _keys(prints: DataFrame) -> DataFrame:
    """(anchor key, home, fp): each distinct fingerprint at its anchors in both halves. The halves'
    keys differ in the top bit."""
    low31 = F.lit((1 << 31) - 1)

    def of_half(half: Column, mark: int) -> Column:
        return F.transform(_anchors(half), lambda a, i: F.struct((a + F.lit(mark)).alias("anchor"), (i == 0).alias("home")))

    halves = F.col("fp").bitwiseAND(low31), F.shiftrightunsigned("fp", 32).bitwiseAND(low31)
    return prints.select("fp", F.inline(F.concat(of_half(halves[0], 0), of_half(halves[1], 1 << 32))))


def _links_of(members: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For the members of one list: (member, root) links that join what the list joins.

    Breadth-first from each member not reached yet; a member is compared only with those not
    reached, and one of two linked members has to be at home."""
    n = len(members)
    root = np.full(n, -1, np.int64)
    rest = np.arange(n)
    order = np.argsort(~home, kind="stable")     # home members start: others need one as a partner
    for start in order:
        if root[start] >= 0:
            continue
        root[start] = start
        queue = [start]
        while queue:
            at = queue.pop()
            rest = rest[root[rest] < 0]
            if not len(rest):
                break
            near = np.bitwise_count(members[rest] ^ members[at]) <= max_bits
            if not home[at]:
                near &= home[rest]
            reached = rest[near]
            root[reached] = start
            queue.extend(reached.tolist())
        if not home[start]:
            break                                 # the rest are guests; guests do not pair up
    got = np.flatnonzero((root >= 0) & (root != np.arange(n)))
    return members[got], members[root[got]]


def _links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows come in order of (list, member): one list at a time is held."""
    key, fps, homes = None, [], []

    def done() -> Iterator[pa.RecordBatch]:
        if fps:
            m, h = np.concatenate(fps).view(np.uint64), np.concatenate(homes)
            if len(m) > 1 and h.any():
                a, b = _links_of(m, h, max_bits)
                if len(a):
                    yield pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    for b in batches:
        k = b["list"].to_numpy(zero_copy_only=False)
        fp, home = b["fp"].to_numpy(zero_copy_only=False), b["home"].to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                if k[lo] != key:
                    yield from done()
                    key, fps, homes = k[lo], [], []
                fps.append(fp[lo:hi].copy())
                homes.append(home[lo:hi].astype(bool))
    yield from done()


def _lists(anchor: Column, other: Column, pieces: int) -> Column:
    """One list for each choice of all but ``MAX_BITS`` of the pieces of ``other`` (its low 32 bits), named by their bits."""
    edges = [32 * i // pieces for i in range(pieces + 1)]
    piece = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    masks = F.lit(np.array([sum(c) for c in combinations(piece, pieces - MAX_BITS)], "int64"))
    return F.transform(masks, lambda m: F.xxhash64(anchor, m, other.bitwiseAND(m)))


def links(prints: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """(a, b) links that connect what is linked among the distinct fingerprints ``prints.fp``.

    Some 30 keys come from each fingerprint, which Spark's estimate of ``prints`` does not tell: taken for as small as
    ``prints``, they would be broadcast. So keys are written once, and met by a merge join of two stored tables, whose skewed
    partitions Spark can split."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves and one spare bit cover 3 differing bits at most")
    keys = written(_keys(prints), "simhash-keys")
    size = keys.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("h"))
    level = reduce(lambda a, c: F.when(F.col("n") > c[0] * crowd, F.lit(c[1])).otherwise(a), CUTS, F.lit(0))
    busy = written(size.filter((F.col("n") > 1) & (F.col("h") > 0)).select("anchor", level.alias("pieces")), "simhash-busy")
    met = keys.join(busy.hint("merge"), "anchor")
    other = F.when(F.col("anchor") < F.lit(1 << 32), F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    lists = F.array(F.xxhash64("anchor"))
    for _, pieces in CUTS:
        lists = F.when(F.col("pieces") == pieces, _lists(F.col("anchor"), other, pieces)).otherwise(lists)
    rows = met.select("fp", "home", F.explode(lists).alias("list"))
    dealt = rows.repartition("list").sortWithinPartitions("list", "fp")
    found = dealt.mapInArrow(lambda it: _links(it, max_bits), "a long, b long")
    return found.distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``df``: its fingerprint as a long and the least id
    that linked fingerprints lead to."""
    docs = written(df.select(F.col(f"`{id_col}`").alias("doc_id"),
                             fingerprint_column(F.col(f"`{text_col}`"), shingle).alias("fp")), "simhash-prints")
    prints = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "simhash-distinct")
    total = prints.agg(F.sum("rows")).first()[0] or 0
    roots = star_components(links(prints.select("fp"), max_bits, crowd))      # (node, root)
    named = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    of_print = join_hot(named, least, "root", total, "prints", ["fp"]).select("fp", "rows", "component_id")
    return join_hot(docs, of_print, "fp", total, "rows").select("doc_id", "fp", "component_id")
