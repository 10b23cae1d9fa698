import re

import pytest

from loomgraph.llm import format_duplicates as fd

SCHEMA = "triple_id long, subject string, relation string, obj string, source_id long, extra string"


def plain(text):
    """Canonical form, plainly: a mark between two digits is content."""
    out = []
    for i, ch in enumerate(text):
        if ch.isalnum():
            out.append(ch.lower())
        elif 0 < i < len(text) - 1 and text[i - 1].isdecimal() and text[i + 1].isdecimal() and not ch.isspace():
            out.append(ch)
    return "".join(out)


def brute(rows):
    groups = {}
    for i, s, r, o, src, _ in rows:
        if not all(x and x.strip() for x in (s, r, o)):
            continue
        a, b = plain(s), plain(o)
        if r == "HỢP_TÁC":
            a, b = sorted((a, b))
        groups.setdefault((r, src, a, b), []).append(i)
    return sorted((min(g), i) for g in groups.values() for i in g if i != min(g))


ROWS = [
    (1, "FPT Corp.", "R", "39,2%", 1, "x"), (2, "fpt corp", "R", "39,2 %", 1, "x"), (3, "FPT-Corp", "R", "392%", 1, "x"), (4, "FPT Corp", "R2", "39,2%", 1, "x"),
    (5, "FPT Corp", "R", "39,2%", 2, "x"), (6, "A", "HỢP_TÁC", "b!", 1, "x"), (7, "B", "HỢP_TÁC", "(a)", 1, "x"), (8, "B", "R", "a", 1, "x"), (9, "a", "R", "b", 1, "x"),
    (10, None, "R", "b", 1, "x"), (11, " ", "R", "b", 1, "x"), (12, " ", "R", "b", 1, "x"), (13, "A", None, "b", 1, "x"), (14, "...", "R", "!", 1, "x"), (15, "?", "R", "-", 1, "x"),
    (16, "Đá", "R", "1.000", None, "x"), (17, "ĐÁ", "R", "1.000", None, "x"), (18, "Da", "R", "1.000", None, "x"), (19, "ĐÁ", "R", "1 000", None, "x"), (20, "x" * 30000, "R", "y", 1, "x"), (21, "X" * 30000, "R", "y", 1, "x"),
    (22, "1..2", "R", "z", 1, "x"), (23, "12", "R", "z", 1, "x"), (24, "1.2", "R", "z", 1, "x"),
]


def test_equals_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(map(tuple, fd.copies(df).collect())) == brute(ROWS)


def test_hot_group_and_empty(spark):
    rows = [(i, "A b", "R", "c", 1, "") if i % 3 == 0 else (i, f"s{i // 2}", "R", "c", 1, "") for i in range(600)]
    assert sorted(map(tuple, fd.copies(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)
    assert fd.copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_collisions_are_regrouped(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = fd.keyed
    monkeypatch.setattr(fd, "keyed", lambda r: real(r).withColumns({"h1": F.lit(0).cast("bigint"), "h2": F.lit(0).cast("bigint")}))
    assert sorted(map(tuple, fd.copies(spark.createDataFrame(ROWS, SCHEMA)).collect())) == brute(ROWS)


@pytest.mark.parametrize("line,want", [('{"subject":"A","object":"B","source_id":3,"relation":"R"}', ("A", "R", "B", 3)), (' {"obj":"\\u0110","relation":"R","subject":"A","source_id":"4"} ', ("A", "R", "Đ", 4)), ('{"subject":"A","ob', None), (None, None), ("", None)])
def test_lines(spark, line, want):
    got = fd.parse_lines(spark.createDataFrame([(1, line)], "triple_id long, line string")).collect()
    assert [tuple(r)[1:] for r in got] == ([want] if want else [])
    assert re.search(fd.MARKS.replace("(?U)", "").replace(r"\p{Nd}", r"\d").replace(r"\p{L}\p{N}", r"\w"), "a b")
