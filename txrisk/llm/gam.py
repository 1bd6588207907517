"""Quality classifier: a generalised additive model with pairwise interactions.

Every text has a dozen features, all column expressions over the text alone (:func:`features`). The
model is a lookup table for each feature over quantile bins, and one for each of a few pairs of
features over a coarser grid, learnt by cyclic boosting: round after round, feature after feature, a
shallow tree (at most three leaves for one feature, four for a pair) is fitted to the gradient of
the log loss and its leaves, shrunk, are added to the table. The pairs are those whose trees gain
most on what the single features leave. A score is the logistic of a sum of looked-up numbers,
found for whole batches by bin searches and additions.

The fit uses at most ``SAMPLE`` labelled rows, those with the least hash of their id, so the driver
never holds more than that many rows of a dozen numbers; below the bound it uses them all. Very long
texts cost time in their task; of them too only a dozen numbers remain. The texts
are read once: features go to the shared folder, and both the fit and the scores start there.

Null and empty texts have zero features and a score like any text. Labels that are null or belong to
no document are ignored; a document with two labels counts as two rows. Without any label
scores are 0.5. Repeated rows get equal scores. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import let, words, written
from txrisk.llm.quality import with_measures

SAMPLE = 20_000
#: Ranges of the id's hash that are counted to find where the sample ends, as a power of two.
CUT_BITS = 12
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 60, 0.1, 1.0

FEATURES = ("log_words", "word_length", "symbols", "repeated_lines", "repeated_words", "stop_words", "shouting",
            "line_length", "capitals", "digits", "stops", "distinct")


def features(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """``keys`` and ``x``, the features of a text as ``array<double>`` in the order of ``FEATURES``."""
    measured, q = with_measures(df, text_col)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    m = lambda c: F.col(f"`{q}`")[c].cast("double")
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    only = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]", "")).cast("double")
    chars = m("word_chars")
    distinct = let(words(text), lambda w: F.size(F.array_distinct(w))).cast("double")
    x = [F.log1p(m("n_words")), per(chars, m("n_words")), per(m("n_symbols"), m("n_words")), per(m("n_dup_lines"), m("n_lines")),
         per(m("n_repeat_words"), m("n_words")), per(m("n_stop"), m("n_words")), per(m("n_shout"), m("n_words")),
         per(m("n_words"), m("n_lines")), per(only(r"\p{Lu}"), chars), per(only("0-9"), chars),
         per(only(".,;:?"), m("n_words")), per(distinct, m("n_words"))]
    return measured.select(*keys, F.array(*x).alias("x"))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Steps for ordered bins from a tree over them with at most so many leaves."""
    worth = lambda a, b: a * a / (b + RIDGE)
    parts, cg, ch = [(0, len(g))], np.concatenate(([0.0], g.cumsum())), np.concatenate(([0.0], h.cumsum()))
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for lo, hi in parts:
            if hi - lo > 1:
                at = np.arange(lo + 1, hi)
                gain = (worth(cg[at] - cg[lo], ch[at] - ch[lo]) + worth(cg[hi] - cg[at], ch[hi] - ch[at])
                        - worth(cg[hi] - cg[lo], ch[hi] - ch[lo]))
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (lo, hi), lo + 1 + k)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    step = np.zeros(len(g))
    for lo, hi in parts:
        step[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + RIDGE)
    return step


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Steps for a grid: one cut of the rows, then a cut of the columns in either part; and the gain."""
    worth = lambda a, b: a * a / (b + RIDGE)
    best, out = -1.0, np.zeros_like(g)
    for cut in range(1, len(g)):
        step, gain = np.zeros_like(g), 0.0
        for rows in (slice(0, cut), slice(cut, len(g))):
            a, b = g[rows].sum(0), h[rows].sum(0)
            s = _tree(a, b, 2)
            step[rows] = s
            for v in np.unique(s):
                gain += worth(a[s == v].sum(), b[s == v].sum())
        if gain > best:
            best, out = gain, step
    return out, best - worth(g.sum(), h.sum())


@dataclass
class Gam:
    """Lookup tables; ``edges[f]`` are the upper ends of the bins of feature ``f`` but the last."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[f], x[:, f])]
        for (i, j), table in self.pairs.items():
            out += table[np.searchsorted(self.pair_edges[i], x[:, i]), np.searchsorted(self.pair_edges[j], x[:, j])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.arange(1, bins) / bins)) if len(v) else np.empty(0)


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """The model of the rows ``x`` with labels 0 or 1; the same rows in any order give the same tables."""
    n, width = len(y), len(FEATURES)
    rate = (y.sum() + 0.5) / (n + 1)
    edges = [_edges(x[:, f], BINS) for f in range(width)]
    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(width)]
    model = Gam(float(np.log(rate / (1 - rate))), edges, [np.zeros(len(e) + 1) for e in edges], coarse)
    if n == 0:
        return model
    at = [np.searchsorted(edges[f], x[:, f]) for f in range(width)]
    margin = np.full(n, model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(width):
            g, h = slopes()
            size = len(model.tables[f])
            step = RATE * _tree(np.bincount(at[f], g, size), np.bincount(at[f], h, size), 3)
            model.tables[f] += step
            margin += step[at[f]]
    low = [np.searchsorted(coarse[f], x[:, f]) for f in range(width)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell = low[i] * shape[1] + low[j]
        g, h = slopes()
        return cell, np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    gains = {}
    for i in range(width):
        for j in range(i + 1, width):
            _, g, h = grid(i, j)
            if min(g.shape) > 1:
                gains[i, j] = _grid_tree(g, h)[1]
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pairs = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for p in chosen:
            cell, g, h = grid(*p)
            step = RATE * _grid_tree(g, h)[0]
            model.pairs[p] += step
            margin += step.ravel()[cell]
    return model


def score_column(x: Column, model: Gam) -> Column:
    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(model.score(b.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))))
    return scores(x)


def fold(doc_id: Column) -> Column:
    """Whether a row is held out of training; rows without an id are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``df``, learnt from the labelled rows that
    are not held out."""
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    table = written(features(docs, "text", ["doc_id"]).withColumn("held_out", fold(F.col("doc_id"))), "gam-features")
    marks = labels.select(F.col(f"`{label_id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    known = table.filter(~F.col("held_out")).join(marks.filter(F.col("y").isin(0, 1)), "doc_id")
    # The sample is the head of the order of a hash. Counts of ranges of that hash tell where it ends, so that only
    # rows near the head are sorted and sent, however many are labelled.
    place = F.shiftright(F.xxhash64("doc_id"), 64 - CUT_BITS)
    total, cut = 0, None
    for r in known.groupBy(place.alias("p")).count().orderBy("p").collect():   # 2^CUT_BITS rows at most
        total, cut = total + r["count"], r["p"]
        if total >= sample:
            break
    head = known.filter(place <= cut) if cut is not None else known
    rows = head.select("doc_id", "y", "x").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(sample).toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    model = fit(x, rows["y"].to_numpy().astype(float))
    scored = table.select("doc_id", "held_out", score_column(F.col("x"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
