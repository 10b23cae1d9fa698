import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import splitting as sp


def greedy(text, limit, overlap):
    """The chain of farthest successors, one after the other."""
    succ, at, out = sp.successors(sp._levels(text), limit, overlap), 0, [0]
    while at < len(text):
        at = int(succ[at])
        out.append(at)
    return out


TEXTS = ["", "a", "a" * 601, "Câu một. " * 200, "é" * 1500, "e\u0301" * 900, "漢字。" * 700, "x " * 900, "👩\u200d💻" * 400]


@pytest.mark.parametrize("limit,overlap", [(600, 60), (20, 5), (7, 6), (10, 0)])
def test_doubling_equals_greedy_and_keeps_the_rules(limit, overlap):
    for text, cuts in zip(TEXTS, sp.cut_all(TEXTS, limit, overlap)):
        assert list(cuts) == greedy(text, limit, overlap)
        pieces = [text[0 if a == 0 else a - overlap : b] for a, b in zip(cuts[:-1], cuts[1:])] if all(c >= overlap for c in cuts[1:]) else None
        if pieces:
            assert all(len(p) <= limit for p in pieces) and "".join([pieces[0], *(p[overlap:] for p in pieces[1:])]) == text
            assert all(q.startswith(p[len(p) - overlap :]) for p, q in zip(pieces, pieces[1:]))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab. ,\n。"), max_size=300))
def test_any_text(text):
    (cuts,) = sp.cut_all([text], 40, 8)
    assert list(cuts) == greedy(text, 40, 8)


def test_reachable_squares():
    succ = np.array([1, 3, 3, 4, 4])
    assert list(np.flatnonzero(sp.reachable(succ, np.array([0])))) == [0, 1, 3, 4]


def test_pieces(spark):
    df = spark.createDataFrame([(1, "Câu một hai. " * 100, 0), (2, "x" * 600, 0), (3, None, 0), (4, "", 0)], "rec_id long, text string, piece_no int")
    got = sp.split_oversized(df, "rec_id").orderBy("piece_no").collect()
    assert {r.rec_id for r in got} == {1} and all(len(r.piece) <= 600 and r.piece == ("Câu một hai. " * 100)[r.start_pos : r.end_pos] for r in got)
    with pytest.raises(ValueError):
        sp.cut_all(["a"], 5, 5)
