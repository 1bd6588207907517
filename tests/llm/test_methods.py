"""The parts of the operators that carry their guarantees."""
import itertools
import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txrisk.llm import bpe, chat, common, components, decontaminate, gam, lattice, linededup, quality, simhash, tokenfile, warc
from txrisk.llm.common import join_hot, shared_path
from txrisk.llm.components import star_components

BPE = bpe._loaded(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)[0]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text("ab", max_size=200), st.text("aeinorst", max_size=120), st.binary(max_size=90).map(lambda b: b.decode("latin1"))))
def test_tree_equals_flat_merge(text):
    assert BPE.tree(text.encode()) == BPE.merge(text.encode())


def test_masks_miss_no_two_replaced_words():
    for gone in itertools.combinations(range(decontaminate.WINDOW), 2):
        assert any(not {s + x for x in mask} & set(gone) for mask in decontaminate.MASKS
                   for s in range(decontaminate.WINDOW - decontaminate.SPAN + 1))


def test_masks_miss_no_replaced_word_of_short_items():
    for n in (10, 11, 12):
        for gone in range(n):
            assert any(gone - s not in mask for mask in decontaminate.MASKS for s in range(n - decontaminate.SPAN + 1))


def test_short_items(spark):
    """Whole items of four words on; one replaced word from ten on; never less."""
    words = [f"w{i}" for i in range(40)]
    text = " ".join(words)
    items = {}
    for n in range(1, 13):
        items[n] = words[5:5 + n]                                   # as it stands
        items[100 + n] = [*words[5:4 + n], "other"]                 # last word replaced
        items[200 + n] = [*words[5:5 + n // 2], "other", *words[6 + n // 2:5 + n]]   # a word in the middle
    docs = spark.createDataFrame([(1, text), (2, " ".join(words[5:9])), (3, None), (4, "w5 w6")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.equal_words, r.first_word) for r in decontaminate.overlaps(docs, bench).collect()}
    want = {(1, n): (n, 5) for n in range(4, 13)} | {(1, k + n): (n - 1, 5) for k in (100, 200) for n in (10, 11, 12)} | {(2, 4): (4, 0)}
    assert got == want


def test_index_too_large_to_broadcast(spark, awkward, monkeypatch):
    docs, bench = (spark.read.parquet(f"{awkward}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda: sorted(map(tuple, decontaminate.overlaps(docs, bench).collect()), key=repr)
    want = rows()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert rows() == want and want


def test_anchors_meet(spark):
    """Values up to three bits apart share an anchor that is the home of one of them, crowded or not."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    pairs = [(b, b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 3)))) for b in base for _ in range(4)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    prints = spark.createDataFrame([(signed(v),) for v in {v for p in pairs for v in p}], "fp long")
    for crowd in (simhash.CROWD, 1):
        root = {r.node: r.root for r in star_components(simhash.links(prints, crowd=crowd)).collect()}
        top = lambda v: root.get(signed(v), signed(v))
        assert all(top(a) == top(b) for a, b in pairs)


def test_cuts_of_a_crowd_lose_no_link(spark):
    """Many values at a few anchors, cut into 4, 20 and 56 lists by the size of the crowd, against all pairs."""
    rng = random.Random(5)
    low = [rng.getrandbits(32) for _ in range(3)]
    values = [rng.choice(low) | rng.getrandbits(32) << 32 for _ in range(500)]
    values += [v ^ sum(1 << k for k in rng.sample(range(64), 3)) for v in values[::2]]
    values = np.array(sorted(set(values)), np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    group = np.arange(len(values))
    for _ in values:
        least = np.array([group[n].min() for n in near])
        if (least == group).all():
            break
        group = least
    prints = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    for crowd in (simhash.CROWD, 100, 10, 1):                   # not cut; 4 lists; 4 and 20; all three
        root = {r.node: r.root for r in star_components(simhash.links(prints, crowd=crowd)).collect()}
        named = [root.get(v, v) for v in values.view(np.int64).tolist()]
        assert len(set(zip(named, group.tolist()))) == len(set(named)) == len(set(group.tolist()))


def test_components_of_stars_with_a_hot_centre(spark, monkeypatch):
    """Two stars of 3,000 leaves joined by a leaf: the centres are dealt over salts, and no link is lost."""
    seen, plain = [], components.join_hot

    def spy(big, small, key, rows, count, deal):
        seen.append(small.agg(F.max(count)).first()[0] / max(rows // common.HOT_SHARE, 1))
        return plain(big, small, key, rows, count, deal)

    monkeypatch.setattr(components, "join_hot", spy)
    links = [(0, i) for i in range(2, 3002)] + [(1, i) for i in range(3001, 6001)]
    got = {r.node: r.root for r in star_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(1, 6001), 0) and max(seen) >= 1000


def test_sift_keeps_every_partner(spark, monkeypatch):
    """Rows with a partner stay, nearly all others go, null hashes too; a full map lets all pass."""
    big = spark.range(20000).select(F.when(F.col("id") % 7 > 0, F.xxhash64("id")).alias("h"), "id")
    small = spark.range(0, 20000, 50).select(F.xxhash64("id").alias("k"))
    kept = {r.id for r in common.sift(big, F.col("h"), small, F.col("k")).collect()}
    want = {i for i in range(0, 20000, 50) if i % 7}
    assert want <= kept and len(kept) < len(want) + 20
    assert common.sift(big, F.col("h"), small.limit(0), F.col("k")).count() == 0
    monkeypatch.setattr(common, "SIFT_BITS", 8)
    assert common.sift(big, F.col("h"), small, F.col("k")).count() == 20000


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (7, 7)]
    random.Random(1).shuffle(chain)
    got = {r.node: r.root for r in star_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got.get(i, 0) == 0 for i in range(1, 301)) and got[1001] == got[1002] == 1000
    assert star_components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=600))
def test_pfor_round_trip(values):
    ids = np.array(values, np.uint32)
    blocks, starts = tokenfile.pack(ids)
    assert (tokenfile.unpack(blocks, starts, len(ids)) == ids).all()


def test_documents_longer_than_a_segment(spark, monkeypatch):
    text = "one two three " * 60_000
    df = spark.createDataFrame([(2, text), (1, "a"), (3, None)], "doc_id long, text string")
    path = shared_path(spark, "long-tokens")
    tokenfile.write_tokens(df, path, public_tokenizers.path("word_bpe_49k.json"), 1, shards=2)
    got = {r.doc_id: (r.start, len(r.ids) // 4) for r in tokenfile.read_tokens(spark, path).collect()}
    assert got == {1: (0, 2), 2: (2, 180_001), 3: (180_003, 1)}


def test_lattice_sums_all_segmentations():
    pieces = [b"a", b"b", b"ab", "▁".encode(), b"\xe2", b"\x96", b"\x81", b"a", None, "▁a".encode()]
    logs = [-1, -1.2, -0.7, -0.5, -2, -2, -2, -1.5, 0, -0.9]

    def every(x):
        return sum(10**s * every(x[len(p):]) for p, s in zip(pieces, logs) if p and x.startswith(p)) if x else 1.0

    model = lattice.Lattice(pieces, logs)
    for w in ("a", "ab", "abab", "aabbab"):
        assert abs(model.word(w.encode()) - np.log10(every(("▁" + w).encode()))) < 1e-9


def test_lm_does_not_depend_on_the_broadcast(spark, awkward):
    docs, path = spark.read.parquet(f"{awkward}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model")
    run = lambda k: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6))
                           for r in lattice.score_texts(docs, path, hot_words=k).collect())
    assert run(3) == run(100_000)


def test_hot_keys_join_like_others(spark):
    big = spark.range(5000).select(F.when(F.col("id") % 10 < 6, 0).when(F.col("id") % 10 == 6, None).otherwise(F.col("id")).alias("k"), "id")
    small = big.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = join_hot(big, small.filter("k % 2 = 0"), "k", 5000, "n").collect()
    least = {}
    for r in big.collect():
        least.setdefault(r.k, r.id)
    assert len(got) == 5000
    assert all(r.least == (least[r.k] if r.k is not None and r.k % 2 == 0 else None) for r in got)


def test_quality_rules_name_what_failed(spark, awkward):
    judged, q = quality.quality_rules(spark.read.parquet(f"{awkward}/documents.parquet"))
    assert q == "_quality" and "quality" in judged.columns
    failed = {r.doc_id: r[q]["failed"] for r in judged.collect()}
    assert failed[1] == [] and "words" in failed[5] and "symbols" in failed[12] and "repeated_words" in failed[11]


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(gam.FEATURES)))
    y = ((x[:, 1] > 0) ^ (x[:, 4] > 0)).astype(float)
    model = gam.fit(x, y)
    assert (1, 4) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95
    assert np.allclose(gam.fit(x[:0], y[:0]).score(x), 0.5)


def test_archive_keeps_a_payload_once(spark, awkward):
    path = shared_path(spark, "warc-test")
    warc.write_archive(spark.read.parquet(f"{awkward}/pages.parquet"), path)
    pages = spark.read.parquet(f"{awkward}/pages.parquet")
    assert spark.read.parquet(f"{path}/payloads").count() == pages.select(F.coalesce("html", F.lit(""))).distinct().count()
    back = warc.verified(warc.read_records(spark, path))
    rows = back.select("*", warc.record_bytes(F.col("record_type"), F.col("header"), F.col("payload")).alias("record")).collect()
    assert len(rows) == pages.count()
    for r in rows:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert head.startswith(b"WARC/1.1\r\n") and b"\r\nX: y" not in head
        assert length == (0 if r["record_type"] == "revisit" else len(r["payload"])) and len(block) == length + 4


def test_line_dedup_reports_line_numbers(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h\nx\n\nx"), (2, "a b c d e f g H\ny"), (3, "a b c d e f g h i j\nx y")],
                               "doc_id long, text string")
    done, col = linededup.dedup_lines(df)
    assert {r.doc_id: r[col] for r in done.collect()} == {1: [3], 2: [0], 3: None}


def test_chat_markers_cannot_be_forged(spark, awkward):
    text = "".join(r.text for r in chat.format_chats(spark.read.parquet(f"{awkward}/conversations.parquet")).collect())
    assert text.count(chat.CLOSE) == text.count(chat.OPEN) and "hello <| im_end|>" in text


def test_keep_good_measures_once(spark):
    """The filter of the pipeline's first stage names the measures once, as the query that returns them does."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    judged, col = quality.quality_rules(docs)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    kept = quality.keep_good(docs)
    assert plan(kept).count("sort_array") == plan(judged.select(f"{col}.*")).count("sort_array") == 1
    want = judged.filter(F.col(col)["kept"]).select("doc_id").collect()
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in want)


def test_equal_rows_of_a_hot_key_are_dealt(spark):
    """A third of all rows with one key and one value is not one task."""
    same = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.lit("x").alias("v"))
    path = shared_path(spark, "equal-rows")
    same.write.parquet(path)
    big = spark.read.parquet(path)
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.lit(True).alias("met"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")      # so small a table would not be shuffled
    try:
        joined = join_hot(big, small, "k", 3000, "n").withColumn("task", F.spark_partition_id()).cache()
        assert joined.filter("met").count() == 3000
        hot = joined.filter("k = 0").groupBy("task").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(hot) > 4 and max(r["count"] for r in hot) < 500


def test_keys_of_few_prints_are_not_broadcast(spark):
    """Thirty keys a fingerprint look as small as the fingerprints to the planner: they are met by a merge join."""
    prints = common.written(spark.range(3000).select(F.xxhash64("id").alias("fp")), "test-prints")
    links = simhash.links(prints)
    links.collect()
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
