"""Every text query: against SQL on awkward, empty and small generated tables, else against plain code."""
import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from oracle import compare
from tokenizers import Tokenizer

from txrisk.llm.queries import ORACLES, QUERIES

NAMES = ["documents", "embeddings", "benchmark", "pages", "labels", "conversations"]


def connect(folder):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def docs_of(folder):
    return pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("which", ["awkward", "nothing", "small"])
def test_against_sql(spark, name, which, request):
    folder = "/root/testdata/sf0.001" if which == "small" else request.getfixturevalue(which)
    got = compare(spark, name, QUERIES[name], ORACLES[name], folder, connect(folder))
    assert got["match"], got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_empty_tables(spark, name, nothing):
    assert QUERIES[name](spark, nothing).count() == 0


def test_bpe_as_tiktoken(spark, awkward):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for d in docs_of(awkward):
        ids = own.encode_ordinary(d["text"] or "")
        want.append((d["doc_id"], len(ids), sha(" ".join(map(str, ids)).encode()), sha((d["text"] or "").encode())))
    assert rows(QUERIES["op2_byte_bpe"](spark, awkward)) == sorted(want, key=repr)


def simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def components(prints, ids, bits=3):
    least = list(range(len(prints)))

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = top(i), top(j)
                least[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(top(i), []).append(ids[i])
    return [min((x for x in groups[top(i)] if x is not None), default=None) for i in range(len(prints))]


def test_simhash_as_brute_force(spark, awkward):
    docs = docs_of(awkward)
    prints, ids = [simhash(d["text"]) for d in docs], [d["doc_id"] for d in docs]
    want = [(i, f"{p:016x}", c) for i, p, c in zip(ids, prints, components(prints, ids))]
    assert rows(QUERIES["op6_simhash"](spark, awkward)) == sorted(want, key=repr)


def test_token_files_as_the_library(spark, awkward):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = []
    for d in docs_of(awkward):
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        coded.append((d["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
    got = rows(QUERIES["op7_token_files"](spark, awkward))
    assert sorted(((i, n, c) for i, _, n, c in got), key=repr) == sorted(coded, key=repr)
    # ascending ids, each starting where the one before ends
    order = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in order] == [0, *np.cumsum([r[2] for r in order])[:-1].tolist()]
    assert [r[0] for r in order] == sorted((r[0] for r in order), key=lambda i: (i is not None, i))


def test_lm_base_as_brute_force(spark, awkward):
    tokens = [(d["doc_id"], [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or "")), None])
              for d in docs_of(awkward)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = count.total(), len(count)
    want = [(i, held(i), len(ws), sum(count[w] > 0 for w in ws), n,
             round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in tokens]
    got = [(*tuple(r)[:5], round(r["base_score"], 6)) for r in QUERIES["op9_lattice_lm"](spark, awkward).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert all(r["score"] < 0 for r in QUERIES["op9_lattice_lm"](spark, awkward).collect())


def test_quality_gam(spark, awkward):
    got = QUERIES["op5_quality_gam"](spark, awkward).collect()
    assert len(got) == len(docs_of(awkward)) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    sf = "/root/testdata/sf0.01"
    scored = QUERIES["op5_quality_gam"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    held = scored.filter("held_out").select("quality", "predicted").collect()
    assert sum(a == b for a, b in held) / len(held) >= 0.9
