"""Oversized texts cut at natural boundaries, with overlap, by pointer doubling.

Method: every boundary of a text (ends of paragraphs and sentences, of clauses,
words, and, where none of these is in reach, of graphemes or bare characters)
is joined to its farthest legal successor: a cut at ``b`` starts a piece at
``b - overlap``, which may reach to ``b - overlap + limit``, and the successor
is the best boundary beyond ``b`` within that reach. The successor table is
squared again and again (``succ[succ]``); the set of cuts reachable from the
beginning doubles with each square, so all greedy cuts come out after
log2(pieces) array steps. The tables of all texts of an Arrow batch are one
array, so a batch of many texts takes no more steps than its longest text.

Each piece has at most ``limit`` characters; each after the first starts with
exactly the last ``overlap`` characters of the one before; without the overlaps
the pieces give the text back.

Defined results: null text gives no piece; an empty text and one within the
limit is one piece as it is, blank or not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.sentences import cut_sentences
from loomgraph.plans.runtime import table

LIMIT = 600
OVERLAP = 60
#: a sentence end that would leave a piece shorter than this is passed over for a later clause or word (0: never)
LEAST = 0

_clause = re.compile(r"[,;:、，；：)\]）】|–—]\s*")
_space = re.compile(r"\s+")
_inner = re.compile("[\u0300-\u036f\u0900-\u0903\u093a-\u094f\u0962\u0963\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u200d\ufe00-\ufe0f\u3099\u309a]|[\U0001f3fb-\U0001f3ff]")


def _levels(text: str) -> np.ndarray:
    """Rank of a cut before each position 0..n: 4 sentence, 3 clause, 2 word, 1 grapheme, 0 inside a grapheme."""
    n = len(text)
    rank = np.ones(n + 1, np.int8)
    for m in _inner.finditer(text):
        rank[m.start()] = 0
        if text[m.start()] == "\u200d":
            rank[m.end()] = 0
    for m in _space.finditer(text):
        rank[m.end()] = 2
    for m in _clause.finditer(text):
        rank[m.end()] = max(rank[m.end()], 3 if m.end() - m.start() > 1 or text[m.start()] in "、，；：）】|" else 1)
    for _, end in cut_sentences(text):
        rank[end] = 4
        while end < n and text[end].isspace():
            end += 1
        rank[end] = 4
    rank[0] = rank[n] = 4
    return rank


def successors(rank: np.ndarray, limit: int, overlap: int, least: int = LEAST) -> np.ndarray:
    """For a cut at each position the farthest legal next cut, of the highest rank within reach."""
    n = len(rank) - 1
    at = np.arange(n + 1)
    start = np.where(at == 0, 0, at - overlap)
    reach = np.minimum(start + limit, n)
    succ = np.minimum(np.maximum(reach, at), n)
    done = reach >= n
    for level in (4, 3, 2, 1):
        last = np.maximum.accumulate(np.where(rank >= level, at, -1))[np.maximum(reach, 0)]
        enough = last > at if level < 4 else last >= np.minimum(start + least, n)  # a cut must lead on
        take = ~done & (last > at) & enough
        succ[take] = last[take]
        done |= take
    return succ


def reachable(succ: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Mask of all cuts on the chains from ``roots``: squares the table until nothing new is reached."""
    mark = np.zeros(len(succ), bool)
    mark[roots] = True
    while True:
        new = mark.copy()
        new[succ[mark]] = True
        if (new == mark).all():
            return mark
        mark, succ = new, succ[succ]


def cut_all(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[np.ndarray]:
    """Cuts (0 and the length included) of each text; the tables of all texts are doubled together."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    tables, base, total = [], [], 0
    for text in texts:
        succ = successors(_levels(text), limit, overlap) + total
        tables.append(succ)
        base.append(total)
        total += len(succ)
    if not texts:
        return []
    mark = reachable(np.concatenate(tables), np.array(base))
    return [np.flatnonzero(mark[b : b + len(t)]) for b, t in zip(base, tables, strict=True)]


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 256):
            part = pdf.iloc[at : at + 256]
            keys, texts = part.iloc[:, 0].tolist(), part.iloc[:, 1].tolist()
            rows = []
            for key, text, cuts in zip(keys, texts, cut_all(texts), strict=True):
                for no, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    first = 0 if a == 0 else a - OVERLAP
                    rows.append((key, no, first, b, text[first:b]))
            yield pd.DataFrame(rows, columns=["key", "piece_no", "start_pos", "end_pos", "piece"])


def split_oversized(records: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Pieces of the texts above the limit: ``key, piece_no, start_pos, end_pos, piece``."""
    over = records.where(F.length(column) > LIMIT).select(F.col(key).alias("key"), column)
    schema = "key bigint, piece_no int, start_pos bigint, end_pos bigint, piece string"
    return over.mapInPandas(_pieces, schema).withColumnRenamed("key", key)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record is oversized if the operator cuts it; its second piece stands for it."""
    return split_oversized(table(spark, sf_dir, "sentence_records"), "rec_id").where("piece_no = 1").select("rec_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces: whole texts within the limit, cut ones above it."""
    records = table(spark, sf_dir, "sentence_records").select("rec_id", "text")
    whole = records.where(F.length("text") <= LIMIT).select(
        "rec_id", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start_pos"),
        F.length("text").cast("bigint").alias("end_pos"), F.col("text").alias("piece"),
    )
    return split_oversized(records, "rec_id").unionByName(whole)


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces}
ORACLES = {"p5_found": "SELECT rec_id FROM sentence_records WHERE length(text) > 600"}
