import random
import re
import unicodedata

import numpy as np

from loomgraph.llm import eval_leakage as el


def words(t):
    t = "".join(ch for ch in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(ch)).replace("đ", "d")
    return re.findall(r"[^\W_]+", t)


def grams(t, span):
    w = words(t or "")
    return {tuple(w[j : j + span]) for j in range(len(w) - span + 1)}


def brute(docs, items, span=15):
    have = [(d, grams(x, span)) for d, x in docs]
    return {(d, i) for i, t in items for want in [grams(t, span)] for d, g in have if g & want}


def corpus():
    rng = random.Random(3)
    vocab = ["Đốn", "phạt", "kè", "2024", "nhà", "ở", "công", "ty", "vốn", "ABC", "thử", "bán", "lô", "giá"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randint(10, 60))) for i in range(12)] + [(90, None), (91, "")]
    docs = []
    for d in range(60):
        w = items[d % 12][1].split()
        k, at = rng.randint(10, 22), rng.randint(0, 8)
        docs.append((d, f"{say(20)} {', '.join(w[at : at + k]).upper() if d % 2 else '-'.join(w[at : at + k])} {say(15)}"))
    return docs + [(100, None), (101, ""), (102, items[0][1] * 300)], items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = corpus()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in el.leaks(d, i).collect()} == want and want
    monkeypatch.setattr(el, "ITEMS_BYTES", 0)  # the shuffle join
    assert {(r.doc_id, r.item_id) for r in el.leaks(d, i).collect()} == want
    assert el.leaks(d.limit(0), i).count() == 0 and el.leaks(d, i.limit(0)).count() == 0


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    for _ in range(50):
        shared = rng.integers(0, 2**63, el.SPAN - el.K + 1).astype(np.uint64)
        a = np.concatenate([rng.integers(0, 2**63, 9).astype(np.uint64), shared, rng.integers(0, 2**63, 5).astype(np.uint64)])
        b = np.concatenate([rng.integers(0, 2**63, 3).astype(np.uint64), shared, rng.integers(0, 2**63, 14).astype(np.uint64)])
        kept = lambda x: set(x[el.winnow(x, np.zeros(len(x)), el.W)])
        assert kept(a) & kept(b)


def test_repeated_rows_and_one_word_texts(spark, monkeypatch):
    docs = [(1, "lô " * 4000), (1, "lô " * 30), (2, "giá " * 14), (None, "lô " * 20)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, "LÔ, " * 25), (7, "lô " * 16)], "item_id long, text string")
    for limit in (el.ITEMS_BYTES, 0):
        monkeypatch.setattr(el, "ITEMS_BYTES", limit)
        got = {(r.doc_id, r.item_id): r.words for r in el.leaks(d, i).collect()}
        assert {k: v for k, v in got.items() if k[0] is not None} == {(1, 7): 25}


def test_windows_stay_within_a_text():
    texts = el.Texts([np.arange(20), np.arange(7), np.arange(15)])
    assert set(texts.owner) == {0, 2} and all(texts.starts[o] <= a and a + el.K <= texts.ends[o] for a, o in zip(texts.at, texts.owner, strict=True))
