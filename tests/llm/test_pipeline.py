"""The pipeline against a plain version of its stages."""
import base64
import re

import duckdb
import public_tokenizers
import tiktoken
from test_queries import components, connect, simhash

import corpus_pipeline
from txrisk.llm.queries import ORACLES


def plain(folder):
    """The rows run() should give: rules, lines and passages by SQL, the rest by direct code."""
    con = connect(folder)
    docs = con.execute("SELECT * FROM documents").to_arrow_table().to_pylist()
    judged = {d: k for d, k in con.execute(f"SELECT doc_id, kept FROM ({ORACLES['op1_quality_rules']})").fetchall()}

    def over(sql, rows):
        one = duckdb.connect()
        one.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        if rows:
            one.executemany("INSERT INTO documents VALUES (?, ?)", [(d["doc_id"], d["text"]) for d in rows])
        one.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{folder}/benchmark.parquet')")
        return one.execute(sql).fetchall()

    docs = [d for d in docs if judged[d["doc_id"]]]
    texts = {i: t for i, _, t in over(ORACLES["op3_line_dedup"], docs)}
    docs = [d | {"text": texts[d["doc_id"]]} for d in docs]
    ids = [d["doc_id"] for d in docs]
    named = components([simhash(d["text"]) for d in docs], ids)
    docs = list({d["doc_id"]: d for d, c in zip(docs, named) if d["doc_id"] == c}.values())
    leaks = {i for i, *_ in over(ORACLES["op4_decontamination"], docs)}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {d["doc_id"]: own.encode_ordinary(d["text"] or "") for d in docs if d["doc_id"] not in leaks}


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, folder).collect()
    want = plain(folder)
    assert {r.doc_id: r.token_ids for r in got} == want and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got)
    assert 0 < len(want) < 200


def test_stages_on_awkward_and_empty_tables(spark, awkward, nothing):
    for folder in (awkward, nothing):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[1:]:   # each on all rows, also those an earlier stage would take
            out = stage(spark, docs, folder)
            n = out.count()
            assert (n > 0) == (folder == awkward)
            if stage is not corpus_pipeline.byte_bpe:
                assert out.columns == docs.columns and re.match("bigint", dict(out.dtypes)["doc_id"])
        assert corpus_pipeline.run(spark, folder).count() >= 0
