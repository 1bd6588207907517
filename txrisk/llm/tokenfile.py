"""Token ids in binary files of patched frame-of-reference (PFOR) blocks.

Layout: a folder of Parquet part files, written by Spark so that a task that runs again cannot leave
a torn file. A row is a segment: the ids of consecutive documents in id order, whole documents up to
``SEGMENT_IDS`` ids together; a longer document is cut into segments of its own.

* ``shard``, ``first``: range of the corpus, and ids of the same shard before the segment;
* ``n_ids`` and ``blocks``: the ids, in blocks of ``BLOCK`` = 256 (the last is filled up with its minimum);
* ``starts``: where each block starts in ``blocks`` (little-endian unsigned 32-bit numbers), so that one
  block can be read alone;
* ``doc_ids``, ``doc_lens``: the documents of the segment and their numbers of ids;
* ``cut``: whether the segment is a piece of one document, which starts at ``doc_first`` in the shard.

A block is: u32 minimum, u8 width, u8 number of exceptions, the values less the minimum in ``width``
bits each (little-endian bit order; exceptions keep their low bits here), then the places of the
exceptions (u8 each) and their values less the minimum (u32 each). The width is at least that of
the ``PERCENTILE`` value, and from there the one that makes the block shortest.

Null and empty texts have just the end id. Rows with the same id stand side by side (shortest first in each
range); equal ones are interchangeable; null ids come first. An empty table gives no rows. Other columns play no part. Very long
texts are encoded in their own task, in memory a few times their length.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 256
SEGMENT_IDS = 1 << 16
PERCENTILE = 0.9
#: Words in one generation of a worker's memory, and bytes of text encoded together.
MEMORY, BYTES_AT_ONCE = 600_000, 1 << 24
#: Stands for a null id among the bounds of ranges.
LEAST = -(1 << 63)
#: Start of the names of special tokens, which the tokenizer looks for before it lowers letters.
SPECIAL = b"<|"

SEGMENT = ("shard int, first long, n_ids int, doc_ids array<long>, doc_lens array<int>, cut boolean, doc_first long, "
           "starts binary, blocks binary")
_ARROW = pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                    ("doc_lens", pa.list_(pa.int32())), ("cut", pa.bool_()), ("doc_first", pa.int64()),
                    ("starts", pa.binary()), ("blocks", pa.binary())])


def pack(ids: np.ndarray) -> tuple[bytes, bytes]:
    """(blocks, starts) of an array of ids."""
    if not len(ids):
        return b"", b""
    n = -(-len(ids) // BLOCK)
    v = np.concatenate((ids, np.full(n * BLOCK - len(ids), ids[(n - 1) * BLOCK:].min()))).astype(np.uint32).reshape(n, BLOCK)
    low = v.min(1)
    v = v - low[:, None]
    bits = np.ceil(np.log2(v.astype(np.float64) + 1)).astype(np.int64)
    by_bits = np.bincount((bits + 34 * np.arange(n)[:, None]).ravel(), minlength=34 * n).reshape(n, 34)
    upto = by_bits.cumsum(1)
    size = np.arange(34) * BLOCK + 40 * (BLOCK - upto)                # bits of a block with that width
    size[upto < PERCENTILE * BLOCK] = np.iinfo(np.int64).max
    width = size.argmin(1)
    packed: list[bytes] = [b""] * n
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        lows = ((v[rows][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
        data = np.packbits(lows.reshape(len(rows), BLOCK * w), axis=1, bitorder="little")
        for r, d in zip(rows.tolist(), data):
            packed[r] = d.tobytes()
    row, place = np.nonzero(bits > width[:, None])
    places, values = place.astype(np.uint8).tobytes(), v[row, place].astype("<u4").tobytes()
    late = np.searchsorted(row, np.arange(n + 1)).tolist()
    parts = [b"".join((m, bytes((w, b - a)), d, places[a:b], values[4 * a:4 * b])) for m, w, d, a, b in
             zip((low[k].tobytes() for k in range(n)), width.tolist(), packed, late, late[1:])]
    starts = np.cumsum([0, *map(len, parts[:-1])])
    return b"".join(parts), starts.astype("<u4").tobytes()


def unpack(blocks: bytes, starts: bytes, n_ids: int) -> np.ndarray:
    """The ids of :func:`pack`."""
    at = np.frombuffer(starts, "<u4").astype(np.int64)
    raw = np.frombuffer(blocks, np.uint8)
    out = np.empty((len(at), BLOCK), np.uint32)
    width = raw[at + 4] if len(at) else np.empty(0, np.uint8)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        size = BLOCK * w // 8
        bits = np.unpackbits(raw[at[rows, None] + 6 + np.arange(size)], axis=1, bitorder="little")
        out[rows] = bits.reshape(len(rows), BLOCK, w) @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
    for k in np.flatnonzero(raw[at + 5]).tolist() if len(at) else ():
        late, a = int(raw[at[k] + 5]), int(at[k]) + 6 + BLOCK * int(width[k]) // 8
        out[k, raw[a:a + late]] = np.frombuffer(blocks, "<u4", late, a + late)
    if len(at):
        out += np.ascontiguousarray(raw[at[:, None] + np.arange(4)]).view("<u4")
    return out.ravel()[:n_ids]


class _Words:
    """Ids of the words met of late, as bytes: two generations, of which the older is forgotten when the
    younger is full."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.young, self.old = kind, {}, {}
        self.plain, self.piece = re.compile(rb"[a-z]+").fullmatch, self.tokenizer.model.tokenize

    def of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of the distinct ``words``."""
        found = list(map(self.young.get, words))
        if None not in found:
            return found
        new = [w for w, ids in zip(words, found) if ids is None]
        if len(self.young) + len(new) > MEMORY:
            self.old, self.young, new = self.young, {}, words
        known = self.young
        if self.old:
            before = list(map(self.old.get, new))
            known.update((w, ids) for w, ids in zip(new, before) if ids is not None)
            new = [w for w, ids in zip(new, before) if ids is None]
        # letters a to z pass the normalizer and the splitter as they are: the model can be asked directly
        plain, piece, kind, rest = self.plain, self.piece, self.kind, []
        for w in new:
            if plain(w):
                known[w] = array(kind, [t.id for t in piece(w.decode())]).tobytes()
            else:
                rest.append(w)
        for lo in range(0, len(rest), 10_000):
            part = rest[lo:lo + 10_000]
            coded = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            known.update((w, array(kind, c.ids).tobytes()) for w, c in zip(part, coded))
        return list(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def _words(path: str, kind: str) -> _Words:
    return _Words(path, kind)


def id_kind(path: str, end_id: int) -> str:
    """Array code of the narrowest unsigned number that holds every id."""
    from tokenizers import Tokenizer
    return "H" if max(Tokenizer.from_file(path).get_vocab_size() - 1, end_id) < 1 << 16 else "I"


def _plain_ids(texts: pa.Array, known: _Words, end: int) -> pa.Array:
    """Ids of texts without names of special tokens, each with the end id behind.

    The words of all texts are numbered by a dictionary, so that only distinct ones are looked up; the ids of
    the words are then laid out by array arithmetic."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    pieces = known.of(coded.dictionary.cast(pa.binary()).to_pylist())  # blanks at a text's ends leave empty words: no ids
    kind = np.dtype("<u2" if known.kind == "H" else "<u4")
    sizes = np.fromiter(map(len, pieces), np.int32, len(pieces)) // kind.itemsize
    starts = np.cumsum(sizes, dtype=np.int32) - sizes
    word = coded.indices.to_numpy()
    n = sizes[word]
    ends = np.concatenate((np.zeros(1, np.int32), np.cumsum(n, dtype=np.int32)))
    offsets = split.offsets.to_numpy()
    upto = ends[offsets - offsets[0]] + np.arange(len(offsets), dtype=np.int32)    # ids before each text, and in all
    # word after word, each text's end id left free
    shift = starts[word] - ends[:-1]
    at = np.repeat(shift, n)
    at += np.arange(len(at), dtype=np.int32)
    laid = np.empty(int(upto[-1]), kind)
    free = np.ones(len(laid), bool)
    free[upto[1:] - 1] = False
    laid[free] = np.frombuffer(b"".join(pieces), kind)[at]
    laid[upto[1:] - 1] = end
    bounds = (upto * kind.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds), pa.py_buffer(laid)])


def _special_ids(text: str, known: _Words, end: bytes) -> bytes:
    """Ids of a text with names of special tokens: words that may hold one keep their case."""
    words = [w if SPECIAL in w else w.lower() for w in text.encode().split()]
    return b"".join(known.of(words)) + end


def _encoded(texts: pa.Array, known: _Words, end_id: int) -> pa.Array:
    special = pc.match_substring(texts, SPECIAL.decode())
    if not pc.any(special).as_py():
        return _plain_ids(texts, known, end_id)
    out = _plain_ids(pc.if_else(special, "", texts), known, end_id).to_pylist()
    end = array(known.kind, [end_id]).tobytes()
    for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
        out[i] = _special_ids(texts[i].as_py(), known, end)
    return pa.array(out, pa.binary())


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in runs of some ``BYTES_AT_ONCE`` bytes, one text at least."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        before = int(upto[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + BYTES_AT_ONCE, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def encode_column(text: Column, doc_id: Column, row: Column, path: str, end_id: int, kind: str, bounds: list[int]) -> Column:
    """struct(shard, ids): a text's ids with the end id behind, as little-endian unsigned numbers (array code ``kind``),
    and its place among the ranges that ``bounds`` part. An id that fills several ranges is dealt over them by ``row``.

    The tokenizer drops white space, never looks across it and lowers all letters, so a text has the
    ids of its words one after another, A-Z in lower case or not; each word is given to the library
    once as long as it is remembered. Names of special tokens have ids of their own, in their own case
    only, so words with ``SPECIAL`` in them keep their case."""
    @F.arrow_udf("shard int, ids binary")
    def encode(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known, cuts = _words(path, kind), np.array(bounds, np.int64)
        for texts, docs, rows in batches:
            at = docs.fill_null(LEAST).to_numpy()
            low, high = np.searchsorted(cuts, at, "left"), np.searchsorted(cuts, at, "right")
            shard = pa.array((low + rows.to_numpy() % (high - low + 1)).astype(np.int32))
            ids = [_encoded(part, known, end_id) for part in _slices(texts.fill_null(""))]
            yield pa.StructArray.from_arrays([shard, pa.concat_arrays([pa.array([], pa.binary()), *ids])], ["shard", "ids"])
    return encode(text, doc_id, row)


def _segments(kind: str):
    """Rows (shard, doc_id, ids) in order, to segments; holds one segment's documents at a time."""
    def row(shard, first, docs, ids, doc_first=None) -> pa.RecordBatch:
        blocks, starts = pack(ids)
        return pa.RecordBatch.from_pylist([{
            "shard": shard, "first": first, "n_ids": len(ids), "doc_ids": [d for d, _ in docs], "doc_lens": [n for _, n in docs],
            "cut": doc_first is not None, "doc_first": doc_first, "starts": starts, "blocks": blocks}], _ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, held, docs, parts = None, 0, 0, [], []
        for b in batches:
            for s, d, raw in zip(b["shard"].to_pylist(), b["doc_id"].to_pylist(), b["ids"].to_pylist()):
                ids = np.frombuffer(raw, "<u2" if kind == "H" else "<u4")
                if docs and (s != shard or held + len(ids) > SEGMENT_IDS):
                    yield row(shard, first, docs, np.concatenate(parts))
                    first, held, docs, parts = first + held, 0, [], []
                if s != shard:
                    shard, first = s, 0
                if len(ids) > SEGMENT_IDS:
                    for lo in range(0, len(ids), SEGMENT_IDS):
                        piece = ids[lo:lo + SEGMENT_IDS]
                        yield row(shard, first + lo, [(d, len(piece))], piece, first)
                    first += len(ids)
                else:
                    docs.append((d, len(ids)))
                    parts.append(ids)
                    held += len(ids)
        if docs:
            yield row(shard, first, docs, np.concatenate(parts))
    return run


def write_tokens(df: DataFrame, out_path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", shards: int | None = None) -> None:
    """Encode ``df`` and write its ids in ascending order of ``id_col`` to the folder ``out_path``.

    A first pass over the ids alone finds the bounds of the ranges (one number a range); texts are then encoded where they
    are read and only their token ids move, once. ``shards``: ranges, by default the shuffle partitions. Rows that share
    an id stand side by side, shortest first within a range; an id with more rows than a range holds
    has several. ``df`` is to give its rows in the same order when a task runs again, as a stored table does."""
    spark = df.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = id_kind(tokenizer_path, end_id)
    doc_id = F.col(f"`{id_col}`").cast("long")
    bounds = df.agg(F.percentile_approx(F.coalesce(doc_id, F.lit(LEAST)), [k / n for k in range(1, n)] or [1.0], max(10_000, 20 * n))).first()[0]
    rows = df.select(doc_id.alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    coded = rows.select("doc_id", "row", encode_column(F.col("text"), F.col("doc_id"), F.col("row"), tokenizer_path, end_id, kind,
                                                       bounds if bounds and n > 1 else []).alias("e"))
    shard = coded.select("e.shard", "doc_id", "e.ids", "row").repartitionById(n, "shard").sortWithinPartitions(
        "shard", F.col("doc_id").asc_nulls_first(), F.octet_length("ids"), "row")
    shard.select("shard", "doc_id", "ids").mapInArrow(_segments(kind), SEGMENT).write.parquet(out_path)


def _docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments to documents, or to pieces of documents that were cut."""
    for b in batches:
        for r in b.to_pylist():
            ids = unpack(r["blocks"], r["starts"], r["n_ids"])
            ends = np.cumsum(r["doc_lens"], dtype=np.int64)
            begins = ends - np.array(r["doc_lens"], np.int64)
            raw = ids.astype("<u4").tobytes()
            n = len(ends)
            yield pa.RecordBatch.from_arrays([
                pa.array([r["shard"]] * n, pa.int32()), pa.array(begins + r["first"]), pa.array(r["doc_ids"], pa.int64()),
                pa.array([r["doc_first"]] * n, pa.int64()),
                pa.array([raw[4 * a:4 * z] for a, z in zip(begins.tolist(), ends.tolist())], pa.binary())],
                ["shard", "at", "doc_id", "doc_first", "ids"])


def _joined(pieces: Column) -> Column:
    @F.arrow_udf("binary")
    def join(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([b"".join(p) for p in b.to_pylist()], pa.binary())
    return join(pieces)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files: its id, how many ids come before it in the
    corpus, and its ids as little-endian unsigned 32-bit numbers.

    Segments are read where they lie; only documents longer than a segment are put together by a
    shuffle. The lengths of the shards (a row each) give the shards' starts."""
    files = spark.read.schema(SEGMENT).parquet(path)
    lengths = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    starts, before = [], 0
    for r in lengths:
        starts.append((r["shard"], before))
        before += r["n"]
    base = spark.createDataFrame(starts, "shard int, base long")
    parts = "shard int, at long, doc_id long, doc_first long, ids binary"
    whole = files.filter(~F.col("cut")).mapInArrow(_docs, parts).select("shard", "at", "doc_id", "ids")
    pieces = files.filter("cut").mapInArrow(_docs, parts).groupBy("shard", "doc_first", "doc_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("p"))
    long = pieces.select("shard", F.col("doc_first").alias("at"), "doc_id", _joined(F.col("p.ids")).alias("ids"))
    docs = whole.unionByName(long).join(F.broadcast(base), "shard")
    return docs.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "ids")
