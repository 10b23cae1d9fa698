import random

import pytest

from loomgraph.llm import corpus_encoding as ce


@pytest.fixture(scope="module")
def enc():
    return ce.encoder(ce.vocabulary_path())


def texts():
    rng = random.Random(7)
    bits = ["a", "b", " ", "  ", "\n", "ế", "1", "22", "!", "漢", "aaaa", "    ", "'s", "'", "\t", "👩‍💻", "ab" * 9, "=-", "<|endoftext|>"]
    return ["", " ", "a" * 900, " " * 700, "漢" * 400, "ab" * 500] + ["".join(rng.choice(rng.sample(bits, rng.randint(1, 5))) for _ in range(rng.randint(1, 200))) for _ in range(150)]


@pytest.mark.parametrize("size", [5, 37, 200])
def test_tree_equals_whole(enc, size):
    for text in texts():
        assert ce.encode_text(enc, text, size) == enc.encode_ordinary(text)
        assert "".join(t for t, _ in ce.leaves(text, size)) == text
    assert enc.decode(ce.encode_text(enc, "Xin chào " * 50, 16)) == "Xin chào " * 50


def test_equals_other_library(enc):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(ce.vocabulary_path().replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    for text in texts():
        assert enc.encode_ordinary(text) == t.encode(text, add_special_tokens=False).ids


def test_column(spark, enc):
    rows = [(1, "Xin chào"), (2, None), (3, ""), (4, "q" * 20000), (5, "từ ngữ " * 4000), (6, " ")]
    got = {r.doc_id: r.ids for r in ce.encode(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in rows}
    assert ce.encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id").count() == 0


def test_equal_and_null_keys_stay_apart(spark, enc, monkeypatch):
    rng = random.Random(2)
    long = ["".join(rng.choice(["漢", "aa", "'s", "=-", "1"]) for _ in range(n)) for n in (9000, 20000, 30000)]
    rows = [(1, long[0]), (1, long[1]), (None, long[2]), (None, long[0]), (2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", spark.range(1).select("id").limit(1).scalar())
    got = sorted(((r.doc_id or -1), r.ids) for r in ce.encode(df, "doc_id").collect())
    assert got == sorted((i or -1, enc.encode_ordinary(t)) for i, t in rows)
