"""Language-model scores: probability of a text over all its segmentations into subwords.

The vocabulary is that of an existing tokenizer; it is not trained here. Its file holds merge ranks,
not probabilities, so the pieces' unigram probabilities are estimated from the training part of the
corpus: how often the tokenizer uses each piece there, plus a half. A text is its words and one end;
a word is segmented with its word-start mark in front and no piece crosses words, so the
probability of a text is the product of those of its words and of the end. The probability of a
word is the sum over all ways to cut it into pieces, by the forward recursion in log space over its
bytes; single-byte pieces make every word possible.

The same pass gives the base score, a unigram over whole words with half a count added.

Work: words are counted in the tasks that read them and summed by a shuffle; each distinct word is
cut and scored once. Texts meet the scores in two ways. The most frequent words of at most ``HOT_BYTES`` bytes,
``HOT_WORDS`` at most and some nine tenths of all occurrences, are broadcast: 51 MB of words at most
whatever the corpus. All other words of a text go, counted, through a join by word. Results do not
depend on which way a word takes, beyond the order of a floating-point sum.

Null and empty texts have just the end. Rows without an id train. Repeated rows are counted and
scored as often as they stand there. Other columns play no part.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import join_hot, written

HOT_WORDS, HOT_BYTES = 200_000, 256
#: The folds, by crc32 of the id as text; this one is kept out of training.
FOLDS, HELD_OUT = 5, 1
START = "▁"   # the mark that the tokenizer puts before a word
TEXTS_AT_ONCE = 2000


def held_out(doc_id: Column, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == fold, F.lit(False))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def _pieces(path: str) -> tuple[list[bytes | None], int]:
    """The bytes that each piece covers (None: a control piece) and the id of the end piece."""
    t = _tokenizer(path)
    out = []
    for i in range(t.get_piece_size()):
        if t.is_byte(i):
            out.append(bytes([int(t.id_to_piece(i)[3:5], 16)]))
        else:
            out.append(None if t.is_control(i) or t.is_unknown(i) else t.id_to_piece(i).encode())
    return out, t.eos_id()


class Lattice:
    """Forward recursion over the pieces with log10 probabilities ``logs`` (by piece id)."""

    def __init__(self, pieces: list[bytes | None], logs: list[float]):
        self.at: dict[bytes, float] = {}
        for p, s in zip(pieces, logs):
            if p:   # a byte piece and a letter piece may cover the same byte: they add up
                self.at[p] = _add(self.at[p], s) if p in self.at else s
        self.longest = max(map(len, self.at), default=0)

    def word(self, word: bytes) -> float:
        """log10 of the summed probability of all segmentations of the word with its mark."""
        text = START.encode() + word
        get, most, sums = self.at.get, self.longest, [0.0]
        for end in range(1, len(text) + 1):
            ways = [sums[start] + s for start in range(max(0, end - most), end)
                    if (s := get(text[start:end])) is not None]
            if len(ways) == 1:
                sums.append(ways[0])
            else:
                top = max(ways)
                sums.append(top + math.log10(sum([10.0 ** (w - top) for w in ways])))
        return sums[-1]


def _add(a: float, b: float) -> float:
    top = max(a, b)
    return top + math.log10(10.0 ** (a - top) + 10.0 ** (b - top))


def _tokens(raw: bytes | None) -> list[bytes]:
    return raw.lower().split() if raw else []   # on bytes: A-Z and the six blanks, nothing else


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, TEXTS_AT_ONCE):
            b = whole.slice(lo, TEXTS_AT_ONCE)
            every, train = Counter(), Counter()
            for raw, held in zip(b["text"].to_pylist(), b["held_out"].to_pylist()):
                (every if held else train).update(_tokens(raw))
            words = list(every.keys() | train.keys())
            yield pa.record_batch({"word": pa.array(words, pa.binary()),
                                   "c": pa.array([train[w] for w in words], pa.int64()),
                                   "n": pa.array([train[w] + every[w] for w in words], pa.int64())})


def _piece_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, total = _tokenizer(path), Counter()
        for b in batches:
            words = [w.decode() for w in b["word"].to_pylist()]
            for ids, c in zip(tokenizer.encode(words, num_threads=1), b["c"].to_pylist()):
                for i in ids:
                    total[i] += c
        yield pa.record_batch({"piece": pa.array(list(total), pa.int32()), "c": pa.array(list(total.values()), pa.int64())})
    return run


def fit(docs: DataFrame, path: str) -> tuple[DataFrame, dict]:
    """From (text binary, held_out): the table (word, c, n, base, log) of all words, with training
    and total counts and both scores, and the numbers that belong to it."""
    found = docs.select("text", "held_out").mapInArrow(_count, "word binary, c long, n long")
    counts = written(found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "lm-counts")
    ends = docs.filter(~F.col("held_out")).count()
    total = counts.agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = (total["c"] or 0) + ends, total["v"] + (1 if ends else 0)
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))

    used = counts.filter("c > 0").select("word", "c").mapInArrow(_piece_counts(path), "piece int, c long")
    by_piece = {r["piece"]: r["c"] for r in used.groupBy("piece").agg(F.sum("c").alias("c")).collect()}  # a row a piece
    pieces, end_piece = _pieces(path)
    by_piece[end_piece] = ends
    able = [i for i, p in enumerate(pieces) if p or i == end_piece]
    mass = sum(by_piece.get(i, 0) for i in able) + 0.5 * len(able)
    logs = [math.log10((by_piece.get(i, 0) + 0.5) / mass) for i in range(len(pieces))]
    shared = docs.sparkSession.sparkContext.broadcast((pieces, logs))   # one row a piece of the vocabulary

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for b in batches:
            yield b.append_column("log", pa.array([lattice.word(w) for w in b["word"].to_pylist()], pa.float64()))

    scored = counts.mapInArrow(score, "word binary, c long, n long, log double")
    bases = F.log10((F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1)))
    table = written(scored.select("word", "c", "n", "log", bases.alias("base")), "lm-words")
    return table, {"train_tokens": n, "end_base": base(ends), "end_log": logs[end_piece], "end_known": int(ends > 0)}


def _most_frequent(words: DataFrame, most: int) -> DataFrame:
    """At most ``most`` words: those whose count reaches the least step of a scale (eight a doubling) that
    so many words reach. A row a step comes to the driver, not a list from each task."""
    step = F.floor(F.log2("n") * 8).cast("int")
    total, cut = 0, None
    for r in sorted(words.groupBy(step.alias("s")).count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        cut = r["s"]
    return words.filter(step >= cut) if cut is not None else words.limit(0)


def score_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                hot_words: int = HOT_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``df``."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text")).withColumn(
        "held_out", held_out(F.col("doc_id")))
    words, facts = fit(docs, path)
    often = _most_frequent(words.filter(F.octet_length("word") <= HOT_BYTES), hot_words)
    hot = spark.sparkContext.broadcast({bytes(r["word"]): (r["base"], r["log"], r["c"] > 0) for r in often.collect()})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        rare = pa.struct([("word", pa.binary()), ("k", pa.int32())])
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS_AT_ONCE):
                b = whole.slice(lo, TEXTS_AT_ONCE)
                out = {"doc_id": b["doc_id"], "held_out": b["held_out"]}
                n_tokens, n_known, base, log, rest = [], [], [], [], []
                for raw in b["text"].to_pylist():
                    counts = Counter(_tokens(raw))
                    s = t = 0.0
                    seen, others = 0, []
                    for w, k in counts.items():
                        if (x := known.get(w)) is not None:
                            s, t, seen = s + k * x[0], t + k * x[1], seen + k * x[2]
                        else:
                            others.append((w, k))
                    n_tokens.append(counts.total())
                    n_known.append(seen)
                    base.append(s)
                    log.append(t)
                    rest.append([{"word": w, "k": k} for w, k in others])
                yield pa.record_batch(out | {
                    "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                    "base": pa.array(base, pa.float64()), "log": pa.array(log, pa.float64()), "rest": pa.array(rest, pa.list_(rare))})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    met = docs.mapInArrow(meet, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, log double, "
                                "rest array<struct<word: binary, k: int>>")
    met = written(met.withColumn("row", F.monotonically_increasing_id()), "lm-texts")
    rare = met.select("row", F.inline("rest")).toDF("row", "word", "k")
    total = words.agg(F.sum("n")).first()[0] or 0
    joined = join_hot(rare, words.select("word", "n", "c", F.col("base").alias("wb"), F.col("log").alias("wl")), "word", total, "n")
    sums = joined.groupBy("row").agg(F.sum(F.col("k") * F.col("wb")).alias("rb"), F.sum(F.col("k") * F.col("wl")).alias("rl"),
                                     F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("rk"))
    added = lambda own, more, end: F.col(own) + F.coalesce(F.col(more), F.lit(0)) + F.lit(end)
    return met.drop("rest").join(sums, "row", "left").select(
        "doc_id", "held_out", (F.col("n_tokens") + 1).alias("n_tokens"),
        added("n_known", "rk", facts["end_known"]).cast("long").alias("n_known"),
        F.lit(facts["train_tokens"]).cast("long").alias("train_tokens"),
        added("base", "rb", facts["end_base"]).alias("base_score"), added("log", "rl", facts["end_log"]).alias("score"))
