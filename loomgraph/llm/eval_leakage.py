"""Evaluation passages inside a training corpus by winnowing.

Method: words (lower case, accents set aside) are hashed, every ``K`` of them
in a row give a k-gram hash, and of each window of ``W`` k-gram hashes in a row
the smallest is kept (winnowing). With K + W - 1 <= ``SPAN`` any span of SPAN
words that two texts share has at least one fingerprint in common. Fingerprints
of corpus and test items are joined; hits are extended to the left and right on
the 64-bit hashes of the words, and a pair counts if a run of at least SPAN words
agrees, so a k-gram collision leaves no trace.

While the file of the items is below ``ITEMS_BYTES``, their fingerprints and
words go to every task and a document is fingerprinted, looked up and extended
in one pass over its batch: nothing is shuffled. Above that, fingerprints are
joined by a shuffle in which one of many rows is split by their number, and only
documents with a hit are joined to their items.

Defined results: null, empty and short texts give no row; a pair comes out
once; an empty corpus or item table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.runtime import materialize, table, within_bytes

SPAN = 15
K = 8
W = SPAN - K + 1
ITEMS_BYTES = 16 << 20
#: rows of one fingerprint that one task joins, before it is split
PRINT_ROWS = 4096
#: ids of documents with a hit up to which they are broadcast (16 bytes each)
BROADCAST_IDS = 1_000_000


def _accent_table() -> tuple[str, str]:
    """Letters with accents and their base letters, from the Unicode decompositions (đ counts as d)."""
    pairs = {"đ": "d", "ð": "ð"}
    for o in [*range(0xC0, 0x250), *range(0x1E00, 0x2000), *range(0x386, 0x3D0), *range(0x400, 0x4FF)]:
        ch = chr(o)
        base = unicodedata.normalize("NFD", ch)
        if len(base) > 1 and unicodedata.combining(base[1]) and ch.islower():
            pairs[ch] = base[0]
    pairs = {a: b for a, b in pairs.items() if a != b}
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _accent_table()


def words(text: Column) -> Column:
    """Maximal runs of letters or digits, letter case and accents set aside."""
    plain = F.translate(F.regexp_replace(F.lower(text), "[\\x{0300}-\\x{036f}]", ""), _FROM, _TO)
    return F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def winnow(hashes: np.ndarray, owners: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of each window of ``window`` hashes of one owner (the rightmost of equal ones)."""
    if len(hashes) < window:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    inside = np.flatnonzero(owners[: len(views)] == owners[window - 1 :])
    return np.unique(inside + window - 1 - views[inside][:, ::-1].argmin(axis=1))


def kgram_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash, modulo 2**64 and mixed, of every ``k`` words in a row."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i : i + n]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


class Texts:
    """Word hashes of many texts in one array, with the winnowed fingerprints of all of them."""

    def __init__(self, rows: list[np.ndarray]):
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.ends = sizes.cumsum()
        self.starts = self.ends - sizes
        self.words = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), sizes)
        grams = kgram_hashes(self.words.view(np.uint64), K)
        whole = np.flatnonzero(owner[: len(grams)] == owner[K - 1 :]) if len(grams) else np.empty(0, np.int64)
        kept = winnow(grams[whole], owner[whole], W)
        self.at = whole[kept]  # place of each fingerprint in ``words``
        self.prints = grams[self.at].view(np.int64)
        self.owner = owner[self.at]

    def __getitem__(self, i: int) -> np.ndarray:
        return self.words[self.starts[i] : self.ends[i]]


def _run(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """Ends of the run of equal words through a[i] = b[j], as places of ``a``."""
    right = a[i : i + len(b) - j] != b[j : j + len(a) - i]
    left = a[max(0, i - j) : i][::-1] != b[max(0, j - i) : j][::-1]
    return i - (int(left.argmax()) if left.any() else len(left)), i + (int(right.argmax()) if right.any() else len(right))


def shared_runs(docs: Texts, items: Texts, enough: int = SPAN) -> dict[tuple[int, int], int]:
    """(document, item) to the length of the longest run that a common fingerprint lies in, if it has ``enough`` words."""
    order = np.argsort(items.prints, kind="stable")
    known = items.prints[order]
    first, last = np.searchsorted(known, docs.prints, "left"), np.searchsorted(known, docs.prints, "right")
    hit = np.flatnonzero(last > first)
    best: dict[tuple[int, int], int] = {}
    seen: dict[tuple[int, int, int], int] = {}  # end of the run extended last on each diagonal
    for h in hit:
        d = int(docs.owner[h])
        i = int(docs.at[h] - docs.starts[d])
        for k in order[first[h] : last[h]]:
            t = int(items.owner[k])
            j = int(items.at[k] - items.starts[t])
            if seen.get((d, t, i - j), -1) > i:
                continue
            start, end = _run(docs[d], items[t], i, j)
            seen[d, t, i - j] = end
            if end - start >= enough and end - start > best.get((d, t), 0):
                best[d, t] = end - start
    return best


def hashed(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``key, hashes``: hashes of the words of each text with at least SPAN words."""
    long = df.where(F.length(column) >= 2 * SPAN - 1).select(F.col(key).cast("bigint").alias(key), words(F.col(column)).alias("w"))
    return long.where(F.size("w") >= SPAN).select(key, F.transform("w", lambda w: F.xxhash64(w)).alias("hashes"))


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = Texts(list(pdf["hashes"]))
        yield pd.DataFrame({"key": pdf["key"].to_numpy()[texts.owner], "print": texts.prints}).drop_duplicates()


def fingerprints(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``key, print``: the distinct winnowed fingerprints of each text with at least SPAN words."""
    return hashed(df, key, column).withColumnRenamed(key, "key").mapInPandas(_fingerprints, "key bigint, print bigint").withColumnRenamed("key", key)


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        runs = [shared_runs(Texts([a]), Texts([b])).get((0, 0), 0) for a, b in zip(pdf["dw"], pdf["iw"], strict=True)]
        yield pdf[["doc_id", "item_id"]].assign(words=runs)


_LEAKS = "doc_id bigint, item_id bigint, words int"


def leaks_in_one_pass(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Leaks with all items (few) at every task."""
    known = hashed(items, "item_id").toPandas()  # bounded by ITEMS_BYTES
    shared = documents.sparkSession.sparkContext.broadcast((known["item_id"].to_numpy(), Texts(list(known["hashes"]))))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts = shared.value
        for pdf in batches:
            keys = pdf["doc_id"].tolist()
            found = shared_runs(Texts(list(pdf["hashes"])), texts)
            yield pd.DataFrame([(keys[d], ids[t], n) for (d, t), n in found.items()], columns=["doc_id", "item_id", "words"])

    found = hashed(documents, "doc_id").mapInPandas(search, _LEAKS)
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))  # a repeated row comes out once


def leaks_by_joins(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Leaks with any number of items."""
    have, want = materialize(fingerprints(documents, "doc_id")), materialize(fingerprints(items, "item_id"))
    parts = have.join(want.select("print").distinct(), "print", "left_semi").groupBy("print").agg(F.ceil(F.count(F.lit(1)) / PRINT_ROWS).cast("int").alias("parts"))
    left = have.join(parts, "print").select("doc_id", "print", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))
    right = want.join(parts, "print").select("item_id", "print", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = materialize(left.join(right, ["print", "part"]).select("doc_id", "item_id").distinct())
    ids = materialize(pairs.select("doc_id").distinct())
    few = ids.count() <= BROADCAST_IDS
    wanted = documents.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    docs, tests = hashed(wanted, "doc_id").withColumnRenamed("hashes", "dw"), hashed(items, "item_id").withColumnRenamed("hashes", "iw")
    checked = pairs.join(docs, "doc_id").join(tests, "item_id").select("doc_id", "item_id", "dw", "iw")
    found = checked.mapInPandas(_verify, _LEAKS).where(F.col("words") >= SPAN)
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, words``: documents that hold a run of SPAN or more words of an item, with its length."""
    documents, items = documents.select("doc_id", "text"), items.select("item_id", "text")
    return leaks_in_one_pass(documents, items) if within_bytes(items, ITEMS_BYTES) else leaks_by_joins(documents, items)


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaking pairs with the length of the longest shared run in words."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


QUERIES = {"p8_found": p8_found, "p8_leaks": p8_leaks}
#: every SPAN words in a row of either side, compared as text
ORACLES = {
    "p8_found": rf"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(replace(strip_accents(lower(text)), 'đ', 'd'), '[\p{{L}}\p{{N}}]+') AS ws FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(replace(strip_accents(lower(text)), 'đ', 'd'), '[\p{{L}}\p{{N}}]+') FROM eval_items),
s AS (SELECT DISTINCT side, id, array_to_string(ws[k : k + {SPAN - 1}], ' ') AS span FROM (SELECT side, id, ws, unnest(range(1, greatest(1, len(ws) - {SPAN - 2}))) AS k FROM w WHERE len(ws) >= {SPAN}))
SELECT DISTINCT a.id AS doc_id, b.id AS item_id FROM s a JOIN s b USING (span) WHERE a.side = 'd' AND b.side = 'i'"""
}
