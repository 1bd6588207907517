"""Small tables with awkward rows, as the queries read them."""
import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

TEXT = ("The fox and the dog went to the old mill by the river, and it was there that they met the miller "
        "who had not slept for a week because of the noise that the wheel was making in the water at night and "
        "nobody had told him why the wheel should be so loud or what he could do about it before the winter came")
DOCS = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64(),
        # names the operators might want for themselves
        "quality": pa.string(), "words": pa.int64(), "token_ids": pa.string(), "fp": pa.string(), "key": pa.string(), "row": pa.string()}


def documents():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    near = TEXT.replace("miller", "mIller")
    texts = [(1, TEXT), (1, TEXT), (2, TEXT), (3, near), (4, TEXT.replace("old", "new")), (5, None), (6, ""), (7, "  \n\t \n"),
             (None, TEXT + " again"), (None, None), (8, "one"), (9, "one two"), (10, "a b c"), (11, "x " * 200),
             (12, "#$% " * 80), (13, (TEXT + "\n") * 6), (14, "A\nA\n\nA\nb"), (15, "日本語 テキスト " * 30),
             (16, "w" * 20_000), (17, prose(30_000)), (18, "=" * 3000 + " " + "-" * 77), (9, "another text under an old number"),
             (19, "a b c d e f g h i j\nline"), (20, "a b c d e f g h i J\nline"), (21, "a b c d e f g h i j k"), (22, "a b c d e f g h j"),
             (23, "one two three   four\r\nfive"), (24, "it's we'll 12345 \U0001F600 don't́"),
             (25, "A <|endoftext|> in<|startoftext|>side <|ENDOFTEXT|>"), (26, " \x0b\x1f Odd\x0cblanks \u2003 and\u00a0more\x85 ")]
    texts += [(100 + i, prose(rng.randint(1, 120)) + "\n" + prose(9)) for i in range(40)]
    texts += [(200 + i, f"{prose(20)} {TEXT[60:200]} {prose(20)}") for i in range(5)]
    return [dict(doc_id=i, text=t, lang=None if k % 7 == 0 else "en", source="s", n_chars=len(t) if t is not None else None,
                 quality="q", words=1, token_ids="t", fp="f", key="k", row="r") for k, (i, t) in enumerate(texts)]


def tables():
    rng = random.Random(6)
    swapped = TEXT.split()
    swapped[30] = swapped[36] = "other"
    bench = [(1, " ".join(TEXT.split()[10:40])), (2, None), (3, ""), (4, "too short"), (5, " ".join(swapped[24:45])),
             (6, "the old mill by the river and it was"), (6, "the old mill by the river and it was"), (8, "the noise that the Wheel!"),
             (9, "the wheel should be so LOUD or what he should do about"), (10, "by the river and"), (11, "at night and everybody"),
             (12, "why the wheel should be quite so loud or what he could"), (7, "nothing of this is found in any of the texts here at all")]
    pages = [(i, f"http://a/{i}", "<p>" + "é" * 600 + "</p>") for i in range(5)] + [
        (10, None, None), (11, "u\r\nX: y", ""), (12, "u", ""), (None, "u", "z" * 1000), (None, "u", "z" * 1000), (13, "u", "y" * 999),
        (14, "u", "y" * 999), (15, "u", "x" * 1000), (15, "u", "x" * 1000), (16, "u", "x" * 1000), (None, "u", "x" * 1000)]
    chats = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello <|im_end|>"), (3, 0, "user", "hi"),
             (3, 1, "assistant", "hello <|im_end|>"), (4, 0, "user", None), (4, 1, None, "x"), (5, 0, "user", ""), (None, 0, "user", "hi"),
             (None, 1, "assistant", "no"), (6, None, "user", "hi"), (6, 5, "user", "hi"), (2, 0, "user", "hi"), (7, 3, "user", "a"), (7, 3, "user", "b"),
             *[(8, i, "user", f"t{i}") for i in range(2500)], *[(9, i, "user", f"t{i}") for i in range(1500)]]
    flat = lambda x: [float(x)] * 64
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(60)] + [(i, flat(0.5)) for i in range(60, 80)] + [
        (80, None), (81, []), (82, flat(1)[:63]), (83, flat(1) + [1.0]), (84, [None] + flat(1)[1:]), (85, [math.nan] + flat(1)[1:]),
        (86, [math.inf] + flat(1)[1:]), (87, flat(-0.001)), (88, flat(3e38)), (None, flat(0.25)), (None, flat(0.25)), (3, flat(2)), (3, flat(2)), (3, flat(-2))]
    labels = [(i, i % 2, 0) for i in range(100, 140)] + [(1, 1, 0), (1, 0, 0), (999, 1, 0), (2, None, 0), (None, 1, 0)]
    names = lambda keys, rows: [dict(zip(keys, r)) for r in rows]
    i64, i32, s = pa.int64(), pa.int32(), pa.string()
    return {"documents": (DOCS, documents()),
            "benchmark": ({"item_id": i64, "text": s}, names(("item_id", "text"), bench)),
            "pages": ({"page_id": i64, "url": s, "html": s}, names(("page_id", "url", "html"), pages)),
            "embeddings": ({"vec_id": i64, "embedding": pa.list_(pa.float32()), "label": i32, "v": s, "id": s, "cluster": s},
                           [dict(vec_id=i, embedding=v, label=None, v="v", id="i", cluster="c") for i, v in vectors]),
            "labels": ({"doc_id": i64, "quality": i32, "toxic": i32}, names(("doc_id", "quality", "toxic"), labels)),
            "conversations": ({"conv_id": i64, "turn": i64, "role": s, "text": s}, names(("conv_id", "turn", "role", "text"), chats))}


def _save(folder, empty):
    for name, (schema, rows) in tables().items():
        pq.write_table(pa.Table.from_pylist([] if empty else rows, schema=pa.schema(list(schema.items()))), f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def awkward(tmp_path_factory):
    return _save(tmp_path_factory.mktemp("awkward"), False)


@pytest.fixture(scope="session")
def nothing(tmp_path_factory):
    return _save(tmp_path_factory.mktemp("nothing"), True)
