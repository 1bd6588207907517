"""Names of special tokens in a text, held against the tokenizer as its file has it."""
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from txrisk.llm import tokenfile
from txrisk.llm.common import shared_path

TEXTS = ["hello <|endoftext|> world", "<|startoftext|>", "A<|endoftext|>B<|startoftext|><|endoftext|>", "<|EndOfText|> <|ENDOFTEXT|>",
         "Before\n<|endoftext|>\tAfter", "<|endoftext", "|endoftext|>", "<|end oftext|>", "É<|endoftext|>é́ UP<|low",
         "<|endoftext|>!<|ENDOFTEXT|>?<|startoftext|>'s", "Plain TEXT", "", None]


def test_special_names_as_the_file_has_them(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    assert want[0] == [3306, 49407, 1002, 1]
    path = shared_path(spark, "special-tokens")
    tokenfile.write_tokens(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), path,
                           public_tokenizers.path("word_bpe_49k.json"), 1, shards=3)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokenfile.read_tokens(spark, path).collect()}
    assert got == want


def test_rows_of_one_id_fill_several_ranges(spark):
    path = shared_path(spark, "hot-id")
    rows = [(7, f"word {i}") for i in range(600)] + [(None, "same text")] * 500 + [(i, "x y") for i in range(-50, 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).sortWithinPartitions("text").cache()
    tokenfile.write_tokens(df, path, public_tokenizers.path("word_bpe_49k.json"), 1, shards=12)
    sizes = spark.read.parquet(path).selectExpr("shard", "inline(arrays_zip(doc_ids))").groupBy("shard").count().collect()
    assert len(sizes) >= 10 and max(r["count"] for r in sizes) < 300
    got = sorted(tokenfile.read_tokens(spark, path).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == [0, *np.cumsum([len(r.ids) // 4 for r in got])[:-1].tolist()]
