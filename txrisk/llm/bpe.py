"""Byte-level BPE by tree reduction.

Token sequences form a monoid: ``encode(x + y)`` is ``join(encode(x), encode(y))``. A piece of text
(one match of the splitting pattern) is halved down to short leaves, leaves are merged directly,
and neighbours are joined by re-encoding a window of ``k`` tokens on either side of the seam. The
join is proven, not guessed: a token sequence is the encoding of its bytes exactly if every two
neighbours are (each pair re-encodes to itself), so a window stands as soon as its outer tokens
pair up with the tokens just outside it; until then ``k`` doubles. Work is n log n in the length
of a piece, so one endless run of letters costs no quadratic time. Between pieces nothing merges:
their joins are plain concatenation, as is decoding.

Pieces repeat, so each Python worker keeps a bounded memory of encoded pieces. Null texts encode as
empty ones; repeated rows get equal ids; other columns are not touched. A row is encoded on its
own, without a shuffle, so a lost task is simply run again.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import fresh

#: Bytes up to which a part is merged directly.
LEAF_BYTES = 24
#: Pieces remembered by a worker before it starts afresh.
MEMORY = 300_000


class Bpe:
    """Encoder and decoder for one table of ranks (token bytes to id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}

    def merge(self, part: bytes) -> list[int]:
        """Merge the lowest-ranked neighbours, leftmost first, until none can be merged."""
        rank, parts = self.ranks.get, [part[i:i + 1] for i in range(len(part))]
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _text(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def _pair(self, x: int, y: int) -> bool:
        return self.tree(self._text([x, y]), join=False) == [x, y]

    def tree(self, part: bytes, join: bool = True) -> list[int]:
        if len(part) <= LEAF_BYTES or not join:
            return self.merge(part)
        half = len(part) // 2
        return self.join(self.tree(part[:half]), self.tree(part[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            window = self.merge(self._text(a + b))
            before, after = left[:-k], right[k:]
            if (not before or self._pair(before[-1], window[0])) and (not after or self._pair(window[-1], after[0])):
                return before + window + after
            k *= 2

    def piece(self, text: str) -> tuple[int, ...]:
        raw = text.encode()
        whole = self.ranks.get(raw)
        return (whole,) if whole is not None else tuple(self.tree(raw))


class _Pieces(dict):
    """Ids of pieces met so far; forgets all when full."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, text: str) -> tuple[int, ...]:
        if len(self) >= MEMORY:
            self.clear()
        self[text] = ids = self.bpe.piece(text)
        return ids


@lru_cache(maxsize=4)
def _loaded(path: str, pattern: str) -> tuple[Bpe, _Pieces, pa.Array]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = Bpe(ranks, pattern)
    table = pa.array([bpe.bytes_of.get(i) for i in range(max(bpe.bytes_of) + 1)], pa.large_binary())
    return bpe, _Pieces(bpe), table


def encode_texts(texts: list[str | None], path: str, pattern: str) -> pa.ListArray:
    bpe, pieces, _ = _loaded(path, pattern)
    flat, ends = array("i"), [0]
    for text in texts:
        if text:
            flat.extend(chain.from_iterable(map(pieces.__getitem__, bpe.split(text))))
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))


def decode_ids(ids: pa.Array, path: str, pattern: str) -> pa.Array:
    """All tokens of the batch end to end, cut at the bounds of the documents."""
    table = _loaded(path, pattern)[2]
    flat, bounds = table.take(ids.values), ids.offsets.to_numpy()
    at, data = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:], flat.buffers()[2]
    if ids.null_count or flat.null_count:
        raise ValueError("an id without a token, or a null list of ids")
    ends = np.ascontiguousarray(at[bounds]) if len(flat) else np.zeros(len(bounds), np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), data]).cast(pa.binary())


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """The token ids of a text, as ``array<int>``; null texts have none."""
    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield encode_texts(b.to_pylist(), path, pattern)
    return encode(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that a list of ids stands for; a null list is as an empty one."""
    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield decode_ids(b, path, pattern)
    return decode(F.coalesce(ids, F.array().cast("array<int>")))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text",
           out: str = "token_ids") -> tuple[DataFrame, str]:
    """``df`` with a column of token ids; returns the frame and that column's name."""
    out = fresh(df, out)
    return df.withColumn(out, encode_column(F.col(f"`{text_col}`"), path, pattern)), out


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "token_ids",
           out: str = "decoded") -> tuple[DataFrame, str]:
    """``df`` with a column of the bytes behind the ids; returns the frame and that column's name."""
    out = fresh(df, out)
    return df.withColumn(out, decode_column(F.col(f"`{ids_col}`"), path, pattern)), out
