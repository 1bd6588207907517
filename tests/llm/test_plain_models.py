"""The learnt operators against plain code: features and fit of the classifier, document scores of the language model."""
import math
import re
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import regex
import sentencepiece

from txrisk.llm import gam, quality
from txrisk.llm.queries import QUERIES

WORD = r"[^\x20\x09-\x0D]+"


def docs_of(folder):
    return pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()


def plain_features(text):
    text = text or ""
    w = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    twice = {i + k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    stops = set(quality._forms(quality.STOP_WORDS))
    per = lambda a, b: a / b if b > 0 else 0.0
    chars, n = sum(map(len, w)), len(w)
    return [math.log1p(n), per(chars, n), per(len(re.findall(r"[#*$%&|<>]", text)), n), per(len(lines) - len(set(lines)), len(lines)),
            per(len(twice), n), per(sum(x in stops for x in w), n), per(text.count("!"), n), per(n, len(lines)),
            per(len(regex.findall(r"\p{Lu}", text)), chars), per(len(re.findall("[0-9]", text)), chars),
            per(len(re.findall("[.,;:?]", text)), n), per(len(set(w)), n)]


def test_features_as_plain_code(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    got = sorted(([r.doc_id, *r.x] for r in gam.features(docs, "text", ["doc_id"]).collect()), key=repr)
    want = sorted(([d["doc_id"], *plain_features(d["text"])] for d in docs_of(awkward)), key=repr)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose(np.array([g[1:] for g in got]), np.array([w[1:] for w in want]), rtol=1e-12, atol=0)


def tree(g, h, leaves):
    """Steps for ordered bins; every cut of every part is tried."""
    worth = lambda lo, hi: (sums[hi][0] - sums[lo][0]) ** 2 / (sums[hi][1] - sums[lo][1] + gam.RIDGE)
    sums = [(0.0, 0.0)]
    for a, b in zip(g, h):
        sums.append((sums[-1][0] + a, sums[-1][1] + b))
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(worth(lo, c) + worth(c, hi) - worth(lo, hi), -k, -c) for k, (lo, hi) in enumerate(parts) for c in range(lo + 1, hi)]
        gain, k, c = max(cuts, default=(0, 0, 0))
        if gain <= 1e-9:
            break
        lo, hi = parts.pop(-k)
        parts += [(lo, -c), (-c, hi)]
    steps = [0.0] * len(g)
    for lo, hi in parts:
        for i in range(lo, hi):
            steps[i] = (sums[hi][0] - sums[lo][0]) / (sums[hi][1] - sums[lo][1] + gam.RIDGE)
    return steps


def grid_tree(g, h):
    """The best cut of the rows with a tree of two leaves over the columns of either part, and what it gains."""
    worth = lambda a, b: a * a / (b + gam.RIDGE)
    best = (-1.0, None)
    for cut in range(1, len(g)):
        gain, steps = 0.0, []
        for lo, hi in ((0, cut), (cut, len(g))):
            a, b = [sum(x) for x in zip(*g[lo:hi])], [sum(x) for x in zip(*h[lo:hi])]
            s = tree(a, b, 2)
            for v in set(s):
                gain += worth(sum(x for x, t in zip(a, s) if t == v), sum(x for x, t in zip(b, s) if t == v))
            steps += [s] * (hi - lo)
        if gain > best[0] + 1e-12:
            best = (gain, steps)
    return best[1], best[0] - worth(sum(map(sum, g)), sum(map(sum, h)))


def plain_fit(x, y, rounds, pair_rounds):
    """Row after row: the scores of the rows ``x`` after boosting on them."""
    n, width = len(y), len(x[0])
    place = lambda v, edges: sum(v > e for e in edges)
    edges = lambda f, k: sorted({float(np.quantile([r[f] for r in x], i / k)) for i in range(1, k)})
    fine, coarse = [edges(f, gam.BINS) for f in range(width)], [edges(f, gam.PAIR_BINS) for f in range(width)]
    at = [[place(r[f], fine[f]) for r in x] for f in range(width)]
    low = [[place(r[f], coarse[f]) for r in x] for f in range(width)]
    rate = (sum(y) + 0.5) / (n + 1)
    margin = [math.log(rate / (1 - rate))] * n

    def slopes():
        p = [1 / (1 + math.exp(-m)) for m in margin]
        return [b - a for a, b in zip(p, y)], [a * (1 - a) for a in p]

    for _ in range(rounds):
        for f in range(width):
            g, h = [0.0] * (len(fine[f]) + 1), [0.0] * (len(fine[f]) + 1)
            for k, (a, b) in enumerate(zip(*slopes())):
                g[at[f][k]] += a
                h[at[f][k]] += b
            step = tree(g, h, 3)
            margin = [m + gam.RATE * step[at[f][k]] for k, m in enumerate(margin)]

    def table(i, j):
        g, h = ([[0.0] * (len(coarse[j]) + 1) for _ in range(len(coarse[i]) + 1)] for _ in range(2))
        for k, (a, b) in enumerate(zip(*slopes())):
            g[low[i][k]][low[j][k]] += a
            h[low[i][k]][low[j][k]] += b
        return grid_tree(g, h)

    gains = {(i, j): table(i, j)[1] for i in range(width) for j in range(i + 1, width)}
    for _ in range(pair_rounds):
        for i, j in sorted(gains, key=lambda p: (-gains[p], p))[:gam.PAIRS]:
            step = table(i, j)[0]
            margin = [m + gam.RATE * step[low[i][k]][low[j][k]] for k, m in enumerate(margin)]
    return [1 / (1 + math.exp(-m)) for m in margin]


def test_fit_as_plain_code(monkeypatch):
    monkeypatch.setattr(gam, "ROUNDS", 6)
    monkeypatch.setattr(gam, "PAIR_ROUNDS", 4)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, len(gam.FEATURES)))
    y = ((x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(scale=0.3, size=240)) > 0).astype(float)
    assert np.allclose(gam.fit(x, y).score(x), plain_fit(x.tolist(), y.tolist(), 6, 4), rtol=1e-9)


def test_sample_is_the_head_of_the_hash_order(spark):
    """The classifier learns from the same rows whether the head is cut out first or all rows are sorted."""
    from pyspark.sql import functions as F
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    picked = []
    keep, gam.fit = gam.fit, lambda x, y: picked.append((x, y)) or keep(x, y)
    try:
        gam.classify(docs, labels, sample=37)
    finally:
        gam.fit = keep
    known = gam.features(docs.filter(~gam.fold(F.col("doc_id"))), "text", ["doc_id"]).join(
        labels.filter("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("y")), "doc_id")
    want = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(37).collect()
    assert picked[0][0].tolist() == [list(r.x) for r in want] and picked[0][1].tolist() == [r.y for r in want]


def test_document_scores_as_plain_code(spark, awkward):
    """Sums over all segmentations as plain products and sums of decimals; nothing is in logs before the end."""
    t = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = [(d["doc_id"], re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or ""))) for d in docs_of(awkward)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = Counter(w for i, ws in docs if not held(i) for w in ws)
    used = Counter()
    for w, c in train.items():
        for p in t.encode(w):
            used[p] += c
    used[t.eos_id()] = sum(not held(i) for i, _ in docs)
    able = [p for p in range(t.get_piece_size()) if p == t.eos_id() or not (t.is_control(p) or t.is_unknown(p))]
    mass = Decimal(sum(used[p] for p in able)) + Decimal(len(able)) / 2
    chance, longest = Counter(), 0
    for p in able:
        if p != t.eos_id():
            raw = bytes([int(t.id_to_piece(p)[3:5], 16)]) if t.is_byte(p) else t.id_to_piece(p).encode()
            chance[raw] += (used[p] + Decimal("0.5")) / mass
            longest = max(longest, len(raw))

    def word(w):
        raw, ways = "▁".encode() + w.encode(), [Decimal(1)]
        for end in range(1, len(raw) + 1):
            ways.append(sum(ways[s] * chance[raw[s:end]] for s in range(max(0, end - longest), end) if raw[s:end] in chance))
        return float(ways[-1].log10())

    logs = {w: word(w) for w in {w for _, ws in docs for w in ws}}
    end = float(((used[t.eos_id()] + Decimal("0.5")) / mass).log10())
    want = sorted(((i, sum(logs[w] for w in ws) + end) for i, ws in docs), key=repr)
    got = sorted(((r.doc_id, r.score) for r in QUERIES["op9_lattice_lm"](spark, awkward).collect()), key=repr)
    assert [i for i, _ in got] == [i for i, _ in want]
    by_id = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert np.allclose([s for _, s in by_id(got)], [s for _, s in by_id(want)], rtol=1e-9)
