import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import sentences
from loomgraph.llm.sentences import cut_sentences, segment

CASES = [
    ("Nhà máy ở TP. Hợn Giổi cung cấp linh kiện, v.v. cho FPT. Lô đầu về.", ["Nhà máy ở TP. Hợn Giổi cung cấp linh kiện, v.v. cho FPT.", "Lô đầu về."]),
    ("Bao bì, v.v. Khoản vay tăng 1.5 lần.", ["Bao bì, v.v.", "Khoản vay tăng 1.5 lần."]),
    ('"Giá đã giảm. Lãi sẽ tăng!" đại diện nói. An hỏi: "Vốn đâu? Ai?" rồi đi.', ['"Giá đã giảm. Lãi sẽ tăng!" đại diện nói.', 'An hỏi: "Vốn đâu? Ai?" rồi đi.']),
    ('An cho biết: "Đã đặt. Lô về tháng 2." Luật sư đến.', ['An cho biết: "Đã đặt. Lô về tháng 2."', "Luật sư đến."]),
    ("Shares fell at 9.30 a.m. before noon. It resumed at 2.15 p.m. Mr. An left the U.S. and Fig. 9 shows No. 3.", ["Shares fell at 9.30 a.m. before noon.", "It resumed at 2.15 p.m.", "Mr. An left the U.S. and Fig. 9 shows No. 3."]),
    ("Lawyers said nothing... yet. N. Tréo Phổn đến.Công ty An mở.", ["Lawyers said nothing... yet.", "N. Tréo Phổn đến.", "Công ty An mở."]),
    ("Tiêu đề bài\nCâu đầu chạy\ntiếp. Hết!\n- Một: 1\n- Hai: 2\nSau đó.", ["Tiêu đề bài", "Câu đầu chạy\ntiếp.", "Hết!", "- Một: 1", "- Hai: 2", "Sau đó."]),
    ("1. Mở tại A\n2. Mở tại B", ["1. Mở tại A", "2. Mở tại B"]),
    ("“我们不会裁员。订单已经恢复。”公司表示。谈判还在继续……公司不愿多说。好！", ["“我们不会裁员。订单已经恢复。”公司表示。", "谈判还在继续……公司不愿多说。", "好！"]),
    ("「守る。続ける。」と述べた。No.399の案件。", ["「守る。続ける。」と述べた。", "No.399の案件。"]),
    ("รายได\u0e49เพ\u0e34\u0e48มข\u0e36\u0e49น 27.9 เปอร\u0e4cเซ\u0e47นต\u0e4cจากป\u0e35ก\u0e48อน การส\u0e48งออกฟ\u0e37\u0e49นต\u0e31ว", ["รายได\u0e49เพ\u0e34\u0e48มข\u0e36\u0e49น 27.9 เปอร\u0e4cเซ\u0e47นต\u0e4cจากป\u0e35ก\u0e48อน", "การส\u0e48งออกฟ\u0e37\u0e49นต\u0e31ว"]),
    ("क\u094dय\u093e ब\u0947च द\u0947ग\u0940? आय 6.9 प\u094dरत\u093fशत बढ\u093c\u0940।", ["क\u094dय\u093e ब\u0947च द\u0947ग\u0940?", "आय 6.9 प\u094dरत\u093fशत बढ\u093c\u0940।"]),
    ("Mã GDKHMBHH.", ["Mã GDKHMBHH."]), ("Đơn tăng 12%; riêng An tăng 3%.", ["Đơn tăng 12%; riêng An tăng 3%."]),
    ("TP\u200b. Nan đến. \u2060Hết.", ["TP\u200b. Nan đến.", "\u2060Hết."]), ("", []), (" \n ", []), (None, []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_cases(text, want):
    assert [text[a:b] for a, b in cut_sentences(text)] == want


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from('aB1.!?… \n"“”「」。，กข ।Đ-)\u200b\u00a0'), max_size=60))
def test_cover_everything(text):
    at = 0
    for a, b in cut_sentences(text):
        assert at <= a < b and not text[a].isspace() and not text[b - 1].isspace() and not text[at:a].strip()
        at = b
    assert not text[at:].strip()


def test_segment(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, "  "), (4, "x. Y" * 5000)], "rec_id long, text string")
    got = segment(df, "rec_id").collect()
    assert sorted((r.start_pos, r.end_pos) for r in got if r.rec_id == 1) == [(0, 4), (5, 9)] and {r.rec_id for r in got} == {1, 4}
    assert segment(df.limit(0), "rec_id").count() == 0


def _texts(text):
    return [text[a:b] for a, b in cut_sentences(text)]


def test_long_quotations_stay_whole():
    quote = "Giá vốn giảm. " * 80
    for left, right in ('""', "“”", "«»", "「」"):
        text = f"Ông nói {left}{quote.strip()}{right} với báo chí. Giá tăng."
        assert len(_texts(text)) == 2
    assert len(_texts('Ông nói "' + quote)) == 80  # never closed


@pytest.mark.parametrize(
    "text,want",
    [
        ("Ông TS. An đến TP. Huế ngày 5.6. Giá tăng.", ["Ông TS. An đến TP. Huế ngày 5.6.", "Giá tăng."]),
        ("Dr. Lee met Mr. Kim, e.g. in No. 5. Prices rose.", ["Dr. Lee met Mr. Kim, e.g. in No. 5.", "Prices rose."]),
        ("股价上涨。iPhone销量下降。", ["股价上涨。", "iPhone销量下降。"]),
        ("डॉ. शर्मा आए। कीमत 5.5 बढ़ी।", ["डॉ. शर्मा आए।", "कीमत 5.5 बढ़ी।"]),
        ("តម្លៃឡើង។ ទីផ្សារចុះ។", ["តម្លៃឡើង។", "ទីផ្សារចុះ។"]),
        ("ဈေးတက်သည်။ ဈေးကျသည်။", ["ဈေးတက်သည်။", "ဈေးကျသည်။"]),
        ("قیمت بڑھی۔ بازار گرا۔", ["قیمت بڑھی۔", "بازار گرا۔"]),
        ("ዋጋ ጨምሯል። ገበያ ወረደ።", ["ዋጋ ጨምሯል።", "ገበያ ወረደ።"]),
        ("ราคา 5 บาท ตลาดหุ้น", ["ราคา 5 บาท", "ตลาดหุ้น"]),
        ("「雇用は守る。投資も続ける。」と述べた。株価は上がった。", ["「雇用は守る。投資も続ける。」と述べた。", "株価は上がった。"]),
    ],
)
def test_languages(text, want):
    assert _texts(text) == want


def test_script_is_the_nearest_letter_however_far():
    digits = "7 " * 60
    assert _texts(f"股价 {digits}。abc {digits}") == [f"股价 {digits}。", f"abc {digits}".strip()]
    assert len(_texts("! " * 30000)) == 30000


def test_rules_look_no_farther_than_they_may():
    from re import _parser

    for name, rules in sentences.TABLES.items():
        for _, before, _ in rules:
            if before and name != "line" and sentences.SP not in before:
                assert _parser.parse(before).getwidth()[1] <= sentences.LEAD or before.endswith(("*", r"\.\.+|…)", r"…|。|！|？|।)")), before
