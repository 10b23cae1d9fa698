import re
from collections import Counter

from loomgraph.llm import term_frequency as tf


def brute(rows):
    occ, recs = Counter(), Counter()
    for row in rows:
        for field, value in zip(("subject", "relation", "obj"), row[:3]):
            if value is None:
                continue
            if field == "relation":
                terms = [value.strip()] if value.strip() else []
            else:
                terms = [t.lower() for t in re.findall(r"[^\W_]+", value)]
            for t in terms:
                occ[field, t] += 1
            for t in set(terms):
                recs[field, t] += 1
    return {(f, t, n, recs[f, t]) for (f, t), n in occ.items()}


def test_counts_and_marks(spark):
    rows = [("Tập đoàn A tập", "R", f"x{i % 7} y_z", 0) for i in range(60)] + [(None, None, None, 0), ("", " ", "…", 0), ("một", " R ", "a-b-a " * 5000, 0)]
    df = spark.createDataFrame(rows, "subject string, relation string, obj string, term int").repartition(5)
    got = tf.marked_terms(df).collect()
    assert {(r.field_name, r.term, r.occurrences, r.records) for r in got} == brute(rows)
    ids = sorted(r.term_id for r in got)
    assert ids == list(range(len(ids)))
    marks = {(r.field_name, r.term): r.mark for r in got}
    assert marks["subject", "một"] == "rare" and marks["relation", "R"] == "common" and marks["obj", "y"] == "common"
    assert all(m == ("rare" if n <= 2 else "common" if n > 0.08 * len(rows) else None) for (f, t), m in marks.items() for n in [next(x[3] for x in brute(rows) if x[:2] == (f, t))])


def test_empty(spark):
    assert tf.marked_terms(spark.createDataFrame([], "subject string, relation string, obj string")).count() == 0


def test_large_dictionaries_give_the_same(spark, monkeypatch):
    rows = [(f"Tập đoàn {i % 90}", f"R{i % 3}", f"x{i} y{i % 11} x{i}", 0) for i in range(700)]
    df = spark.createDataFrame(rows, "subject string, relation string, obj string, term int").repartition(4)
    monkeypatch.setattr(tf, "RANGE", 64)
    monkeypatch.setattr(tf, "BROADCAST_TERMS", 0)
    assert {(r.field_name, r.term, r.occurrences, r.records) for r in tf.marked_terms(df).collect()} == brute(rows)
