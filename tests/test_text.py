import unicodedata

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as tx
from loomgraph.plans import rules


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_normalize_text(spark):
    given = ["Ngày\u00a016/1,\u2003ông\u200bRoland", "GDP tăng–trưởng 6,5%", "“Chuyển đổi số” nâng cao", "Giá  tương   đương", "Ha\u0300 No\u0323i", None, "", " \n a\nb "]
    want = ["Ngày 16/1, ôngRoland", "GDP tăng-trưởng 6,5%", '"Chuyển đổi số" nâng cao', "Giá tương đương", "Hà Nọi", "", "", "a\nb"]
    assert column(spark, given, tx.normalize_text) == [unicodedata.normalize("NFC", w) for w in want]
    assert column(spark, ["a\u2003b"], lambda c: tx.normalize_text(c, rules.CHAR_MAP_BASIC)) == ["a\u2003b"]
    assert len(rules.CHAR_MAP) == 18 and len(rules.ALIASES) == 37 and len(rules.CANONICAL) == 20


def test_normalize_entity(spark):
    given = ["VCB", "Tập đoàn FPT", '"Viettel",', "a", "12.345", "x" * 81, "100%", None, "  ", "A  B"]
    assert column(spark, given, tx.normalize_entity) == ["Vietcombank", "FPT", "Viettel", "", "", "", "100%", "", "", "A B"]


def test_canonicalize(spark):
    assert column(spark, ["TP HCM", " Facebook ", "Apple Inc.", "Lạ", None], tx.canonicalize) == ["TP.HCM", "Meta", "Apple", "Lạ", None]


def test_casts(spark):
    assert column(spark, ["3.7", "x", None, "1e2"], lambda c: tx.as_long(c, F.lit(9).cast("bigint"))) == [3, 9, 9, 100]
    assert column(spark, [None, "", " ", " A "], lambda c: tx.first_filled(c, default="D")) == ["D", "D", "D", "A"]


def pack(text, most=600):
    """The packing rule, plainly."""
    import re

    out, buf = [], ""
    for sent in re.split(r"(?<=[.!?;])\s+", (text or "").strip()):
        if len(buf) + len(sent) + 1 <= most:
            buf = (buf + " " + sent).strip()
            continue
        out += [buf] if buf else []
        if len(sent) > most:
            out += [p for p in (sent[i : i + most].strip() for i in range(0, len(sent), most)) if p]
            buf = ""
        else:
            buf = sent
    out += [buf] if buf.strip() else []
    return [p for p in out if len(p) >= 5]


@pytest.mark.parametrize("most", [12, 30, 600])
def test_pack_sentences(spark, most):
    given = ["Một câu. Hai câu! Ba câu? Bốn; năm.", "x" * 70, "", None, "a. b. c.", "Dài " * 40 + ". Ngắn."]
    assert column(spark, given, lambda c: tx.pack_sentences(c, most)) == [pack(t, most) for t in given]


def test_model_chunks(spark):
    got = column(spark, ["Aaa bbb. Ccc ddd. Eee", ""], lambda c: tx.model_chunks(c, 10))
    assert [(x.chunk, x.start) for x in got[0]] == [("Aaa bbb.", 0), ("Ccc ddd.", 9), ("Eee", 18)]


def test_jaccard(spark):
    df = spark.createDataFrame([("a b", "B c"), ("", "a"), ("x", "x X")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(tx.jaccard(F.col("a"), F.col("b"))).collect()] == [0.3333, 0.0, 1.0]
