import itertools

import pytest

from loomgraph.llm import name_variants as nv

GROUPS = [
    [("Ông Rác Nhác Chạt Mộc", "PERSON"), ("R. Nhác Chạt Mộc", "person"), ("Rac Nhac Chat Moc", "PERSON"), ("Rác N. Chạt Mộc", None), ("Mộc Nhác Chạt Rác", "PERSON"), ("Nhác Chạt Mộc, Rác", "PERSON"), ("Rác Nhác Chạy Mộc", "PERSON")],
    [("William C. Plimglopobrenemorv", "PERSON"), ("Bill Plimglopobrenemorv", "PERSON"), ("Plimglopobrenemorv, William C.", "PERSON"), ("Mr. W. Plimglopobrenemorv", "PERSON"), ("William Plimglopobremorv", "PERSON")],
    [("Công ty TNHH Quợi Quạch Truỷ Truỗng", "ORGANIZATION"), ("Quoi Quach Truy Truong Ltd.", "ORGANIZATION"), ("Quợi Quạch Truỷ Truỗng, Công ty TNHH", "UNKNOWN"), ("Cty TNHH Quợi Quạchh Truỷ Truỗng", "organization"), ("Quợi Quạch Truỷ Truỗng (QQTT)", "ORGANIZATION")],
    [("Công ty TNHH Quợi Quạch Truỷ Truỗng Chi nhánh 2", "ORGANIZATION"), ("Quoi Quach Truy Truong Chi nhanh 2 Co., Ltd", "ORGANIZATION")],
    [("Tập đoàn Sộn Giẫu Khuộn Nhưởng", "ORGANIZATION")], [("Sộn Giẫu Khuộn Nhưởng", "PERSON")], [("Robert C. Plimglopobrenemorw Smithers", "PERSON")],
    [("Pin Vi Plus G27", "PRODUCT")], [("Pin Vi Plus G28", "PRODUCT")], [("", "PERSON")], [(None, "PERSON")], [("  ", None)], [("5G", None)],
]


def test_links(spark):
    rows, want = [], set()
    for group in GROUPS:
        ids = []
        for name, etype in group:
            ids.append(len(rows))
            rows.append((len(rows), name, etype, "clash"))
        want |= set(itertools.combinations(ids, 2))
    df = spark.createDataFrame(rows, "node_id long, node string, entity_type string, entity_id string")
    got = {r.node_id: r.entity_id for r in nv.entities(df).collect()}
    pairs = {(a, b) for a, b in itertools.combinations(sorted(got), 2) if got[a] == got[b]}
    assert pairs == want


def test_empty(spark):
    assert nv.entities(spark.createDataFrame([], "node_id long, node string, entity_type string")).count() == 0


@pytest.mark.parametrize("a,b,most,want", [("abc", "abc", 1, 0), ("abc", "acb", 1, 1), ("abc", "abd", 1, 1), ("abc", "ab", 1, 1), ("abc", "xyz", 1, 2), ("", "ab", 2, 2)])
def test_edits(a, b, most, want):
    assert min(nv.edits(a, b, most), most + 1) == want


def test_rare_tokens_count_more():
    same = lambda wa, wb: nv.name_similarity(["a1", "bb", "cc"], ["a1", "bb", "cc"], wa, ["zz", "bb", "cc"], ["zz", "bb", "cc"], wb, True)
    assert same([1.0, 1.0, 1.0], [1.0, 1.0, 1.0]) > same([9.0, 1.0, 1.0], [1.0, 1.0, 1.0])


SHORT = [
    ("Jon Smith", "John Smith"), ("Bob Lee", "Robert Lee"), ("J. Smith", "John Smith"), ("John F. Smith", "John Smith"), ("Christopher Lee", "Chris Lee"),
    ("Rác N. Chạt Mộc", "R. Nhác Chạt Mộc"), ("kovdreyomirewim Lee", "kovrdeyoimrewim Lee"), ("Jonn Smyth", "John Smith"), ("Marlowens Kit", "Marlowenst Kit"),
]


@pytest.mark.parametrize("a,b", SHORT)
def test_similar_names_are_candidates(spark, a, b):
    df = spark.createDataFrame([(0, a, "PERSON"), (1, b, "PERSON")], "node_id long, node string, entity_type string")
    names = nv.weighted_names(nv.parsed_names(df)[1])
    x, y = sorted(names.collect(), key=lambda r: r.node_id)
    assert nv.name_similarity(x.core, x.flat, x.w, y.core, y.flat, y.w, True) >= nv.ENOUGH
    assert [tuple(r) for r in nv.candidates(names).collect()] == [(0, 1)]


def test_short_names_are_linked(spark):
    rows = [(i, n, "PERSON") for i, n in enumerate(["Jon Smith", "John Smith", "Bob Lee", "Robert Lee", "Christopher Kim", "Chris Kim", "John F. Dorn", "J. Dorn", "John Dorn", "Anna Brandt"])]
    got = {r.node_id: r.entity_id for r in nv.entities(spark.createDataFrame(rows, "node_id long, node string, entity_type string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6}


def test_initials_alone_are_no_evidence():
    assert nv.name_similarity(["john", "s"], ["john", "s"], [1.0] * 2, ["j", "smith"], ["j", "smith"], [1.0] * 2, True) == 0.0


def test_an_initial_stands_for_names_with_its_letter_only():
    same = lambda a, b: nv.token_similarity(a, b, a, b)
    assert same("ron", "x") == same("x", "ron") == 0.0 and same("ron", "r") == same("r", "bob") == same("bob", "r") == same("b", "bob") == 0.9 and same("robert", "b") == 0.0
