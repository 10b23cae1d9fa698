import pytest
from pyspark.sql import functions as F

from loomgraph.operators import bio, relations, spans, training
from loomgraph.plans import rules


def found(text, families=rules.FAMILIES):
    import re

    return [(text[a:b], t) for a, b, t in spans.find_spans(text, [(t, re.compile(p)) for t, ps in families.items() for p in ps])]


def test_regex_families():
    text = "Ngày 16/1, GDP tăng 6,5% trong năm 2024. Giá 1000 USD, tương đương 12 triệu đồng."
    assert set(found(text)) == {("12 triệu đồng", "MONEY"), ("1000 USD", "MONEY"), ("12 triệu", "MONEY"), ("Ngày 16/1", "DATE"), ("năm 2024", "DATE"), ("6,5%", "PERCENT"), ("tăng 6,5%", "PERCENT")}
    assert [len(p) for p in rules.FAMILIES.values()] == [4, 18, 10, 25, 11] and sum(map(len, rules.FAMILIES_BASIC.values())) == 13
    assert found("watchOS 26") == [] and found("iOS 17") == [("iOS 17", "PRODUCT")]
    assert found("") == [] and found("Vietnam AI Summit 2024")[0][1] == "EVENT"


def test_required_words_lose_nothing():
    import re

    for pattern, words in rules.REQUIRED.items():
        for text in ("Tech Summit 2024", "Giải thưởng Sao 2024", "ngày hội việc làm 2024", "Olympic Paris 2024", "12 triệu đồng", "tăng 5%"):
            if re.search(pattern, text):
                assert any(w in text.lower() for w in words)


def test_resolve_overlaps(spark):
    cases = [[(0, 5, "A", 1), (3, 9, "B", 2), (9, 12, "C", 1)], [(0, 4, "A", 1), (0, 6, "B", 1)], [(2, 4, "A", 1), (0, 3, "B", 1)], []]
    want = [[(3, 9, "B"), (9, 12, "C")], [(0, 6, "B")], [(0, 3, "B")], []]
    df = spark.createDataFrame([(i, [(a, b, t, p, 1.0) for a, b, t, p in c]) for i, c in enumerate(cases)], "i int, s array<struct<start:int,end:int,etype:string,priority:int,score:double>>")
    got = [[(s.start, s.end, s.etype) for s in r.o] for r in df.orderBy("i").select(spans.resolve_overlaps(F.col("s")).alias("o")).collect()]
    assert got == want


@pytest.mark.parametrize("automaton", [True, False])
def test_dictionary(automaton):
    m = spans.Matcher(spans.default_dictionary() + [("hr asia awards 2025", "HR Asia Awards 2025", "EVENT", True)])
    if not automaton:
        m.automaton = False
    words = lambda t: [(t[a:b], k) for a, b, k in m(t)]
    assert words("Apple ra mắt iPhone 17 tại HR Asia Awards 2025, ngành công nghệ rất sôi động.") == [("HR Asia Awards 2025", "EVENT"), ("công nghệ", "INDUSTRY")]
    assert words("Tôi mua iPhone 17 và AirPods Pro 3.") == [("AirPods", "PRODUCT")]
    assert words("đây là trò game đơn giản") == [] and words("lĩnh vực du lịch phục hồi tốt") == [("du lịch", "INDUSTRY")]
    assert words("fpt và FPTX") == [] and words("") == [] and m(None) == []


def test_tokens():
    words = lambda t: [w for w, _, _ in bio.cut_tokens(t)]
    assert words('"(FPT),"') == ['"', "(", "FPT", ")", ",", '"']
    assert words("năm 2024.") == ["năm", "2024."] and words(None) == [] and words(" \n") == []
    text = "Ông (An), «Bình»... 5,5%!"
    assert all(text[a:b] == w for w, a, b in bio.cut_tokens(text))


def test_spans_to_bio_and_back(spark):
    df = spark.createDataFrame([("năm 2024.", [(0, 8, "DATE")]), ("An Bình", [(0, 7, "PERSON")])], "t string, s array<struct<start:int,end:int,etype:string>>")
    rows = df.select(bio.spans_to_bio(bio.tokens("t"), F.col("s")).alias("b")).withColumn("l", bio.to_string(F.col("b")))
    got = rows.select("l", bio.decode(F.col("b")).alias("e"), (bio.from_string(F.col("l")) == F.col("b")).alias("same")).collect()
    assert got[0].l == "năm B-DATE\n2024. O" and got[1].l == "An B-PERSON\nBình I-PERSON"
    assert [(e.text, e.etype) for e in got[1].e] == [("An Bình", "PERSON")] and all(r.same for r in got)


def test_fixes(spark):
    cases = [
        ([("đồng/lít", "I-MONEY")], [("đồng", "B-MONEY"), ("/", "O"), ("lít", "O")]), ([("tỷ", "B-MONEY"), ("phú", "I-MONEY")], [("tỷ", "O"), ("phú", "O")]),
        ([("MacBook", "O"), ("Pro", "O")], [("MacBook", "B-PRODUCT"), ("Pro", "O")]), ([("Google", "O"), ("Pixel", "O")], [("Google", "B-PRODUCT"), ("Pixel", "I-PRODUCT")]),
        ([("ChatGPT", "B-ORGANIZATION")], [("ChatGPT", "B-PRODUCT")]), ([("Google", "O"), ("I/O", "O")], [("Google", "O"), ("I", "O"), ("/", "O"), ("O", "O")]),
        ([("x", "I-A"), ("y", "I-A"), ("z", "I-B")], [("x", "B-A"), ("y", "I-A"), ("z", "B-B")]), ([], []),
        ([("//a", "B-X"), ("/", "B-X"), ("km/h", "I-X")], [("/", "O"), ("/", "O"), ("a", "B-X"), ("/", "O"), ("km/h", "B-X")]),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)] + [(99, None)], "i int, b array<struct<token:string,label:string>>")
    got = {r.i: r.f and [tuple(x) for x in r.f] if r.f is not None else None for r in df.select("i", bio.fixed(F.col("b")).alias("f")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)} | {99: None}


def test_tokens_of_odd_texts():
    words = lambda t: [w for w, _, _ in bio.cut_tokens(t)]
    assert words("`mã` ...x) ..5, a(b ((«x»)).") == ["`mã`", "...x", ")", "..5,", "a(b", "(", "(", "«", "x", "»", ")", ")", "."]
    assert words("m² 5². (.5) \u2028x") == ["m²", "5².", "(", ".5", ")", "x"]
    assert len(words("." * 20000)) == 20000 and len(words("x" * 100000)) == 1


RECORD = "row_id long, text string, entities array<struct<text:string,etype:string,score:double>>"
PERSON, BIDV, VPB, FPT, HANOI = ("Trương Gia Bình", "PERSON"), ("BIDV", "ORGANIZATION"), ("VPBank", "ORGANIZATION"), ("FPT", "ORGANIZATION"), ("Hà Nội", "LOCATION")


def _extracted(spark, rows):
    rows = [(i, t, e if e is None else [(*x, 1.0) if len(x) == 2 else x for x in e]) for i, (t, e) in enumerate(rows)]
    found = relations.extracted(spark.createDataFrame(rows, RECORD)).orderBy("row_id", "emit_no").collect()
    return [(r.row_id, r.subject, r.relation, r.obj, r.confidence) if not r.error else (r.row_id, r.error) for r in found]


def test_relations(spark):
    got = _extracted(spark, [
        ("Ông Trương Gia Bình - Chủ tịch FPT phát biểu tại sự kiện.", [PERSON, FPT]), ("BIDV và VPBank ký kết hợp tác chiến lược tại Hà Nội.", [BIDV, VPB, HANOI]),
        ("a", [("Ab", "ORGANIZATION", 1.0), ("Cd", "ORGANIZATION", 0.9998)]), ("a", [("Ab", "ORGANIZATION", 1.0), ("Cd", "ORGANIZATION", 0.9997)]),
        (None, [FPT]), ("x", None), ("x", []), (" ", [FPT, BIDV]), ("FPT hợp tác với BIDV.", [("FPT", "ORGANIZATION", float("nan")), BIDV]),
        ("Doanh thu FPT đạt 12 tỷ đồng", [("Xyz", "PERSON", None)]), ("BIDV hợp tác với VPBank" + " x" * 100, [BIDV, VPB, BIDV]),
    ])
    assert got == [
        (0, "Trương Gia Bình", "LÃNH_ĐẠO", "FPT", 0.85), (0, "Trương Gia Bình", "LIÊN_QUAN", "FPT", 0.5),
        (1, "BIDV", "LIÊN_QUAN", "VPBank", 0.5), (1, "VPBank", "LIÊN_QUAN", "BIDV", 0.5), (1, "BIDV", "LIÊN_QUAN", "Hà Nội", 0.5), (1, "VPBank", "LIÊN_QUAN", "Hà Nội", 0.5),
        (2, "Ab", "LIÊN_QUAN", "Cd", 0.5), (2, "Cd", "LIÊN_QUAN", "Ab", 0.5), (3, "Ab", "LIÊN_QUAN", "Cd", 0.4999), (3, "Cd", "LIÊN_QUAN", "Ab", 0.4999),
        (8, "score is no number"), (9, "Doanh thu FPT", "CÓ_GIÁ_TRỊ", "12 tỷ đồng", 0.75),
        (10, "BIDV", "HỢP_TÁC", "VPBank", 0.8), (10, "VPBank", "HỢP_TÁC", "BIDV", 0.8),
    ]


def test_cooccurrence_is_part_of_the_extraction(spark):
    text = "BIDV và VPBank tại Hà Nội."
    ents = [("BIDV", "ORGANIZATION", 1.0), ("VPBank", "ORGANIZATION", 0.9997), ("Hà Nội", "LOCATION", 0.9)]
    df = spark.createDataFrame([(1, text, ents), (2, None, ents), (3, text, [])], RECORD)
    alone = sorted((r.subject, r.obj, r.confidence) for r in relations.cooccurrence(df).collect())
    assert alone == sorted((r.subject, r.obj, r.confidence) for r in relations.triples(df).where("relation = 'LIÊN_QUAN'").collect()) and len(alone) == 4


def test_verbs_lose_no_match():
    import re

    texts = ("FPT hợp tác với BIDV", "FPT tăng trưởng 20%/năm", "Ông An, CEO của FPT", "Hội chợ Sao diễn ra tại Hà Nội", "FPT có trụ sở tại Hà Nội", "FPT trị giá 5 tỷ USD")
    for _, pattern, *_ in rules.RELATIONS:
        verbs = re.search(r"\(\?:[^()]*\)", pattern)[0]
        assert pattern.count(verbs) >= 1 and verbs in relations._verbs(pattern).replace("(?U)", "").replace(r"\p{L}\p{N}_", r"\w")
        assert all(re.search(verbs, t) for t in texts if re.search(pattern, t))


def test_miscellaneous_model_entities_are_dropped(spark):
    df = spark.createDataFrame([("Tết ở Huế", [("Tết", "MISC", 0.99), ("Huế", "LOC", 0.9), ("ở", "PER", 0.1), ("Tết", None, 0.9)])], "t string, e array<struct<text:string,etype:string,score:double>>")
    got = df.select(spans.model_spans(F.col("t"), F.col("e")).alias("s")).first().s
    assert [(s.start, s.end, s.etype) for s in got] == [(6, 9, "LOCATION")]


def test_digits_of_other_scripts():
    assert {t for t, _ in found("tăng ２０ % và ５００ tỷ đồng")} >= {"２０ %", "５００ tỷ đồng"}


def test_training(spark):
    seqs = spark.createDataFrame([(1, ["a", "b", "c"], ["B-X", "I-X", "O"]), (2, [], []), (3, ["d"], ["B-Y"])], "seq_id long, tokens array<string>, labels array<string>")
    assert sorted((r.seq_id, r.chunk_no, len(r.tokens)) for r in training.chunked(seqs, 2).collect()) == [(1, 0, 2), (1, 1, 1), (2, 0, 0), (3, 0, 1)]
    assert [tuple(r) for r in training.label_ids(seqs).orderBy("label_id").collect()] == [("O", 0), ("B-X", 1), ("B-Y", 2), ("I-X", 3)]
    rows = spark.range(200).withColumnRenamed("id", "seq_id").withColumn("chunk_no", F.lit(0))
    assert {r.part: r["count"] for r in training.split(rows).groupBy("part").count().collect()} == {"test": 10, "validation": 20, "train": 170}
    w = spark.range(1000).select(F.col("id").alias("seq_id"), F.when(F.col("id") < 100, 3.0).otherwise(1.0).alias("weight"))
    draws = training.resampled(w).collect()
    assert sum(r.draws for r in draws) == 1000 and 220 <= sum(r.draws for r in draws if r.seq_id < 100) <= 280
    pred = seqs.withColumn("p", F.when(F.col("seq_id") == 3, F.array(F.lit("O"))).otherwise(F.col("labels")))
    micro = training.scores(pred, "labels", "p").where("etype = 'micro'").first()
    assert (micro.precision, micro.recall) == (1.0, 0.5)
    assert training.token_accuracy(pred, "labels", "p").first()[0] == 0.75


def test_align(spark):
    df = spark.createDataFrame([(["ab", "abcdef"], [5, 7])], "w array<string>, t array<int>").withColumn("ids", training.word_ids(F.col("w"), lambda x: (len(x) + 2) // 3, 8))
    assert df.select(training.align_labels(F.col("ids"), F.col("t"))).first()[0] == [-100, 5, 7, -100, -100]


def test_dictionary_join_equals_the_automaton(spark):
    names = ["HR Asia", "HR Asia Awards 2025", "công nghệ", "AirPods", "iPhone 17", "FPT", "«Sao»", "C++", "…", "TP.HCM", "a b a", "du lịch"]
    rows = [(i, n, ("INDUSTRY" if n in ("công nghệ", "du lịch") else "EVENT"), n not in ("công nghệ", "du lịch")) for i, n in enumerate(names)]
    gazetteer = spark.createDataFrame(rows, "entry_id long, orig_name string, etype string, case_sensitive boolean")
    texts = ["Apple ra mắt iPhone 17 tại HR Asia Awards 2025, ngành công nghệ rất sôi động.", "AirPods, C++ và «Sao» ở TP.HCM; fpt FPTX FPT", "a b a b a", "…", "", None, "lĩnh vực du lịch du lịch", "công nghệ"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    matcher = spans.Matcher(spans.dictionary_entries(gazetteer))
    got = {r.id: [(s.start, s.end, s.etype) for s in r.spans] for r in spans.joined_dictionary_spans(df, "id", "t", gazetteer).collect()}
    assert got == {i: [m for m in matcher(t) if t[m[0] : m[1]] != "…"] for i, t in enumerate(texts)} and sum(map(len, got.values())) == 11


def test_sample_per_group(spark):
    from loomgraph.operators import reporting

    df = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("g")).repartition(5)
    got = [(r.g, r.id) for r in reporting.sample_per_group(df, "g", "id", 4).collect()]
    assert sorted((g or "") for g, _ in got) == [""] * 4 + ["1"] * 4 + ["2"] * 4
    assert set(got) == {(r.g, r.id) for r in reporting.sample_per_group(df.coalesce(1), "g", "id", 4).collect()}
