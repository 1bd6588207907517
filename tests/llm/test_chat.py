"""Conversations whose rows share turn numbers: one key may hold most rows of a table."""
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare
from test_queries import connect

from txrisk.llm import chat
from txrisk.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def crowded(awkward, tmp_path_factory):
    """Half of the rows have the null id and three turn numbers, a null one among them; conversation 21
    restarts at turn 0, and 22 is a proper prefix of it."""
    folder = tmp_path_factory.mktemp("crowded")
    chats = [(None, (None, 0, 1)[i % 3], "user", f"t{i}") for i in range(6000)]
    chats += [(21, i % 5, "user", f"r{i}") for i in range(3000)] + [(i, t, "user", f"s{i}") for i in range(30, 40) for t in range(3)]
    first = sorted(r for r in chats if r[0] == 21 and r[1] == 0)
    assert len(first) < chat.BLOCK
    chats += [(22, *r[1:]) for r in first]
    keys = ("conv_id", "turn", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    pq.write_table(pa.Table.from_pylist([dict(zip(keys, r)) for r in chats], schema=schema), f"{folder}/conversations.parquet")
    for t in ("documents", "embeddings", "benchmark", "pages", "labels"):
        pq.write_table(pq.read_table(f"{awkward}/{t}.parquet"), f"{folder}/{t}.parquet")
    return str(folder)


def test_shared_turn_numbers_against_sql(spark, crowded):
    got = compare(spark, "op10_chat", QUERIES["op10_chat"], ORACLES["op10_chat"], crowded, connect(crowded))
    assert got["match"], got


def test_no_block_beyond_its_positions(spark, crowded):
    rows = spark.read.parquet(f"{crowded}/conversations.parquet").selectExpr(
        "conv_id", "turn", "unhex(md5(concat(role, text))) AS c", "1L AS size")
    placed = chat.numbered(chat.ranged_turns(rows))
    assert max(r["count"] for r in placed.groupBy("conv_id", "block").count().collect()) == chat.BLOCK
    ks = sorted(r.k for r in placed.filter("conv_id IS NULL").collect())
    assert ks == list(range(1, 6001))


def test_parts_end_at_the_row_bound(spark, crowded):
    """One rule for every conversation, with long texts above a small bound."""
    table = spark.read.parquet(f"{crowded}/conversations.parquet")
    big = spark.createDataFrame([(50, t, "user", "é" * 300) for t in range(20)], table.schema)
    bound, got = 1000, {}
    for r in chat.format_chats(table.union(big), row_bytes=1000).collect():
        got.setdefault(r.conv_id, []).append(r)
    whole = {}
    for i, text in connect(crowded).execute(f"SELECT conv_id, text FROM ({ORACLES['op10_chat']}) ORDER BY conv_id, part").fetchall():
        whole[i] = whole.get(i, "") + text
    whole[50] = "".join("<|im_start|>user\n" + "é" * 300 + "<|im_end|>\n" for _ in range(20))
    assert set(got) == set(whole)
    for i, parts in got.items():
        parts.sort(key=lambda r: r.part)
        assert "".join(r.text for r in parts) == whole[i]
        assert [r.part for r in parts] == [sum(p.n_turns for p in parts[:j]) for j in range(len(parts))]
        sizes = [len(r.text.encode()) for r in parts]
        assert max(r.n_turns for r in parts) <= chat.BLOCK
        assert all(n <= bound + 640 for n in sizes)
    assert len(got[50]) >= 10
