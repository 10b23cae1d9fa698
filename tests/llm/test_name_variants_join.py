import itertools
import random

from pyspark.sql import functions as F

from loomgraph.llm import name_variants as nv

SCHEMA = "node_id long, node string, entity_type string"


def _groups(spark, names, etype="ORGANIZATION"):
    rows = [(i, n, etype) if isinstance(n, str) else (i, *n) for i, n in enumerate(names)]
    return {r.node_id: r.entity_id for r in nv.entities(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_names_of_one_token(spark):
    names = ["Vingroup", "Tập đoàn Vingroup", "Vingrup", "Vingroup JSC", "FPT", "FPT Corp", "Công ty FPT", "Viettel", "Viettel Group", "Tập đoàn Viettel", "VNG", "VNPT", "Hòa", "Hóa"]
    got = _groups(spark, names)
    assert got == {**dict.fromkeys(range(4), 0), **dict.fromkeys(range(4, 7), 4), **dict.fromkeys(range(7, 10), 7)}


def test_names_of_unlike_length(spark):
    names = ["Tan Hoang Phat", "Tan Hoang Phat Trading", "Viet Phat", "Viet Phatt", "Công ty Thương mại Đại Lộc Nguyên", "Đại Lộc Nguyên", "Zuckerberg Media"]
    names += [f"{a} {b}" for a, b in itertools.product(("Kombu", "Tarvo", "Leshi"), ("Wranex", "Oltira"))]
    got = _groups(spark, names)
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_shared_family_names_are_no_candidates(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdghklmnprstvx") + rng.choice("aeiou") for _ in range(4))
    given = sorted({word() for _ in range(2000)})
    rows = [(i, f"Nguyen Van {g.title()}", "PERSON") for i, g in enumerate(given)]
    names = nv.weighted_names(nv.parsed_names(spark.createDataFrame(rows, SCHEMA))[1])
    assert nv.candidates(names).count() < 5 * len(given)  # all pairs would be near two million


def test_recall_against_brute_force(spark):
    """Every pair that the similarity accepts must be a candidate, on names with edits, initials and short forms."""
    rng = random.Random(5)
    first = ["John", "Robert", "Anna", "William", "Katherine", "Duc", "Minh", "Christopher"]
    last = ["Brandtwood", "Kovdreyomire", "Lee", "Smith", "Ostergard", "Trinh", "Chinh", "Mercadante", "Dornik", "Valtierra"]
    names = []
    for _ in range(260):
        parts = [rng.choice(first), *rng.sample(last, rng.choice((1, 1, 2)))]
        at = rng.randrange(len(parts))
        how, t = rng.randrange(7), parts[at]
        i = rng.randrange(len(t) - 1)
        if how == 0:
            parts[at] = t[:i] + t[i + 1 :]
        elif how == 1:
            parts[at] = t[:i] + t[i + 1] + t[i] + t[i + 2 :]
        elif how == 2:
            parts[0] = parts[0][0] + "."
        elif how == 3:
            parts[0] = nv.SHORT_FORMS.get(parts[0].lower(), parts[0]).split()[0].title()
        elif how == 4:
            parts.insert(1, "F.")
        elif how == 5:
            parts = [*parts[1:], parts[0]] if len(parts) == 2 else parts
        names.append(" ".join(parts))
    rows = [(i, n, "PERSON") for i, n in enumerate(dict.fromkeys(names))]
    weighted = nv.weighted_names(nv.parsed_names(spark.createDataFrame(rows, SCHEMA))[1])
    have = {(r.a, r.b) for r in nv.candidates(weighted).collect()}
    known = weighted.collect()
    want = set()
    for x, y in itertools.combinations(sorted(known, key=lambda r: r.node_id), 2):
        if nv.name_similarity(x.core, x.flat, x.w, y.core, y.flat, y.w, True) >= nv.ENOUGH:
            want.add((x.node_id, y.node_id))
    assert len(want) > 100
    assert len(want & have) >= 0.99 * len(want)


def test_similar_tokens_are_all_found(spark):
    rng = random.Random(7)
    tokens = {"".join(rng.choice("abcde") for _ in range(rng.randrange(3, 11))) for _ in range(500)}
    for t in list(tokens)[:200]:
        i = rng.randrange(len(t) - 1)
        tokens.add(rng.choice((t[:i] + t[i + 1 :], t[:i] + "f" + t[i:], t[:i] + t[i + 1] + t[i] + t[i + 2 :])))
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    got = {(r.a, r.b) for r in nv.similar_vocabulary(df).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(tokens), 2) if nv.similar_tokens(a, b)}
    assert len(got & want) >= 0.99 * len(want)
    assert not got - want


def test_repeated_and_clashing_rows(spark):
    df = spark.createDataFrame([(5, "FPT Corp", "ORGANIZATION"), (9, "FPT Corp", "ORGANIZATION"), (7, None, None), (8, " ", "PERSON"), (11, "A. B.", "PERSON")], SCHEMA)
    df = df.withColumns({"name_id": F.lit(1), "h": F.lit("x"), "core": F.lit("y"), "w": F.lit(0)})
    assert {r.node_id: r.entity_id for r in nv.entities(df).collect()} == {5: 5, 9: 5}
