import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import look_alikes as la

CASES = [
    ("１５％", "15%"), ("Ngày\u00a01", "Ngày 1"), ("Tr\u200cờ\u00adn", "Trờn"), ("ТΜCP Сhi", "TMCP Chi"), ("ha\u0300 no\u0323\u0302i", "hà nội"),
    ("tðng Ɖuể", "tđng Đuể"), ("Quα\u0306\u0300ng", "Quằng"), ("a\u3000b\u2003c", "a b c"), ("giá， tăng", "giá, tăng"), ("Ｈｅllo", "Hello"),
]
KEPT = [
    "公司会不会出售？", "银行（Co., Ltd.）股价，下跌", "“Không” – nói… ½ m² 5 °C № 8 Δ β 25 µm ™", "Đối tác Северника и Кордель", "a\tb\r\nc", "👩\u200d💻 ok ❤\ufe0f", "प\u094dरत\u093fशत बढ\u093c\u0940।", "ธารามณฑ\u0e4c", "", " ", "Ω 5 Ω",
]


@pytest.mark.parametrize("given,want", CASES)
def test_changed(given, want):
    assert la.normalize_text(given) == unicodedata.normalize("NFC", want)


@pytest.mark.parametrize("text", KEPT)
def test_kept(text):
    assert la.normalize_text(text) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aâế Đ\u0301\u0323\u200b\u200d\u00a0Ａ，，。漢字кожСΑα👩💻\n\t1½"), max_size=40))
def test_idempotent_and_composed(text):
    once = la.normalize_text(text)
    assert la.normalize_text(once) == once


def test_quick_check_misses_nothing(spark):
    texts = [t for t, _ in CASES] + KEPT + [None, "plain", "x" * 50000 + "\u200b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("normal0", F.lit(1))
    got = {r.id: r.normal for r in la.consistent(df, "text").collect()}
    assert got == {i: la.normalize_text(t) for i, t in enumerate(texts)}
    assert la.consistent(df.limit(0), "text").count() == 0


def test_quick_check_over_all_code_points(spark):
    """No text that composition changes may pass: every character alone, and after a letter or mark it may join."""
    import sys
    import unicodedata

    texts = []
    for o in range(0x80, sys.maxunicode + 1):
        ch = chr(o)
        if 0xD800 <= o < 0xE000:
            continue
        for text in (ch, f"a{ch}", f"ọ{ch}", f"α{ch}", f"क{ch}", f"ᄀ{ch}"):
            if unicodedata.normalize("NFC", text) != text:
                texts.append(text)
    texts += [unicodedata.normalize("NFD", chr(o)) for o in range(0x80, 0x30000) if unicodedata.decomposition(chr(o))[:1] not in ("", "<")]
    assert len(texts) > 3000
    missed = [t for t in set(texts) if not la._unstable.search(t) and unicodedata.normalize("NFC", t) != t]
    assert missed == []
    rows = spark.createDataFrame([(t,) for t in sorted(set(texts)) if unicodedata.normalize("NFC", t) != t], "text string")
    assert rows.where(~la.is_unstable(F.col("text"))).count() == 0


def test_more_scripts():
    assert la.normalize_text("cօmpany Wᏼ ꓐank ⲣhone ᴄat windoⅴs") [:7] == "company"
    for text, want in (("vօn", "von"), ("ꓐank", "Bank"), ("ⲣhone", "phone"), ("ᴄat", "cat"), ("Ꮃin", "Win"), ("windoⅴs", "windovs")):
        assert la.normalize_text(text) == want
    for text in ("Հայաստան", "ᎠᏂᏴᏫᏯᎢ", "Ⅲ", "γ", "магазин", "σύνολο"):
        assert la.normalize_text(text) == text
