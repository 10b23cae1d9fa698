"""Frequency of every distinct term by a global integer dictionary and count arrays.

Method: the distinct terms, combined in each block before anything is shuffled,
are range-partitioned and get dense integer ids (partition offset + place). The
terms of every record are then encoded by that dictionary, and each block adds
them to count arrays of occurrences and of records, one pair of arrays for each
range of ``RANGE`` ids; a block sends on only the filled places of its arrays, so
a term that holds a third of all occurrences is one entry a block. The arrays
are summed by identifier range, one range at a time.

A dictionary of at most ``BROADCAST_TERMS`` terms is sent to every block. A larger
one is joined by a shuffle, for which every block first counts its own terms.

Defined results: null and blank values give no term; a value without letters or
digits gives none; relation terms are whole trimmed values; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.runtime import materialize, table

RANGE = 4096
#: terms up to which the dictionary is broadcast (about 60 bytes each)
BROADCAST_TERMS = 250_000
RARE_ROWS = 2
COMMON_SHARE = 0.08
FIELDS = ("subject", "relation", "obj")


def record_terms(records: DataFrame) -> DataFrame:
    """``field_name, term, occ``: each distinct term of each record's field with its occurrences there."""
    trimmed = F.regexp_replace("relation", r"(?U)^\s+|\s+$", "")
    runs = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    lists = records.select(
        F.explode(
            F.array(
                F.struct(F.lit("subject").alias("field_name"), F.transform(runs("subject"), F.lower).alias("terms")),
                F.struct(F.lit("obj").alias("field_name"), F.transform(runs("obj"), F.lower).alias("terms")),
                F.struct(F.lit("relation").alias("field_name"), F.filter(F.array(trimmed), lambda v: v != "").alias("terms")),
            )
        ).alias("f")
    ).select("f.field_name", "f.terms")
    return lists.select(
        "field_name", F.explode(F.array_distinct("terms")).alias("term"), "terms"
    ).select("field_name", "term", F.size(F.filter("terms", lambda v: v == F.col("term"))).cast("bigint").alias("occ"))


def dictionary(terms: DataFrame) -> DataFrame:
    """``field_name, term, term_id``: dense ids in range order of (field_name, term)."""
    distinct = materialize(
        terms.select("field_name", "term").distinct().repartitionByRange("field_name", "term")
        .withColumn("mono", F.monotonically_increasing_id())
    )
    part, place = F.shiftright("mono", 33), F.col("mono").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r[0], r[1]) for r in distinct.groupBy(part.alias("p")).count().collect())  # a row a partition
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    base = distinct.sparkSession.createDataFrame(offsets or [(0, 0)], "p bigint, base bigint")
    return distinct.withColumn("p", part).join(F.broadcast(base), "p").select(
        "field_name", "term", (F.col("base") + place).alias("term_id")
    )


def encoded(records: DataFrame, words: DataFrame) -> DataFrame:
    """``rng, slot, occ, recs``: terms of every record by the dictionary, in the partitions of the records where it is broadcast."""
    terms = record_terms(records)
    if words.count() <= BROADCAST_TERMS:
        found = terms.join(F.broadcast(words), ["field_name", "term"]).select("term_id", "occ", F.lit(1).cast("bigint").alias("recs"))
    else:  # each block counts its own terms before they are shuffled to the dictionary
        blocks = terms.withColumn("block", F.spark_partition_id()).groupBy("block", "field_name", "term").agg(F.sum("occ").alias("occ"), F.count(F.lit(1)).alias("recs"))
        found = blocks.join(words, ["field_name", "term"]).select("term_id", "occ", "recs")
    return found.select(F.expr(f"term_id div {RANGE}").alias("rng"), (F.col("term_id") % RANGE).cast("int").alias("slot"), "occ", "recs")


def _block_arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Count arrays of one block, a pair for each range of ids met; only the filled places leave it."""
    sums: dict[int, np.ndarray] = {}
    for pdf in batches:
        code = pdf["rng"].to_numpy(np.int64) * RANGE + pdf["slot"].to_numpy(np.int64)
        ids, at = np.unique(code, return_inverse=True)
        occ = np.bincount(at, pdf["occ"].to_numpy(float), len(ids)).astype(np.int64)
        recs = np.bincount(at, pdf["recs"].to_numpy(float), len(ids)).astype(np.int64)
        bounds = np.flatnonzero(np.diff(ids // RANGE, prepend=-1))
        for a, b in zip(bounds, [*bounds[1:], len(ids)], strict=True):
            both = sums.setdefault(int(ids[a] // RANGE), np.zeros((2, RANGE), np.int64))
            both[:, ids[a:b] % RANGE] += (occ[a:b], recs[a:b])
    for rng in sorted(sums):
        occ, recs = sums.pop(rng)
        slots = np.flatnonzero(recs)
        yield pd.DataFrame({"rng": [rng], "slots": [slots.astype(np.int32)], "occ": [occ[slots]], "recs": [recs[slots]]})


def _sum_arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the block arrays; rows come in the order of ranges, so that one range is held at a time."""
    at, both = None, np.zeros((2, RANGE), np.int64)
    for pdf in batches:
        for rng, slots, occ, recs in zip(pdf["rng"], pdf["slots"], pdf["occ"], pdf["recs"], strict=True):
            if at is not None and rng != at:
                yield pd.DataFrame({"rng": [at], "occ": [both[0].copy()], "recs": [both[1].copy()]})
                both[:] = 0
            at = rng
            both[:, slots] += (occ, recs)
    if at is not None:
        yield pd.DataFrame({"rng": [at], "occ": [both[0]], "recs": [both[1]]})


def count_arrays(records: DataFrame, words: DataFrame) -> DataFrame:
    """``rng, occ, recs``: count arrays of RANGE ids each, summed over all blocks."""
    blocks = encoded(records, words).mapInPandas(_block_arrays, "rng bigint, slots array<int>, occ array<bigint>, recs array<bigint>")
    return blocks.repartition("rng").sortWithinPartitions("rng").mapInPandas(_sum_arrays, "rng bigint, occ array<bigint>, recs array<bigint>")


def term_counts(records: DataFrame) -> DataFrame:
    """``field_name, term, term_id, occurrences, records`` of every term."""
    words = materialize(dictionary(record_terms(records)))
    counts = (
        count_arrays(records, words)
        .select("rng", F.posexplode(F.arrays_zip("occ", "recs")).alias("slot", "c"))
        .where("c.recs > 0")
        .select((F.col("rng") * RANGE + F.col("slot")).alias("term_id"), F.col("c.occ").alias("occurrences"), F.col("c.recs").alias("records"))
    )
    return words.join(counts, "term_id").select("field_name", "term", "term_id", "occurrences", "records")


def marked_terms(records: DataFrame) -> DataFrame:
    total = records.count()
    mark = F.when(F.col("records") <= RARE_ROWS, "rare").when(F.col("records") > COMMON_SHARE * total, "common")
    return term_counts(records).withColumn("mark", mark)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(table(spark, sf_dir, "triples").select(*FIELDS)).where("mark is not null").select("field_name", "term", "mark")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its number of occurrences and of records, and its mark (empty if neither rare nor common)."""
    return marked_terms(table(spark, sf_dir, "triples").select(*FIELDS)).select(
        "field_name", "term", "occurrences", "records", F.coalesce("mark", F.lit("")).alias("mark")
    )


_TERMS = r"""
WITH runs AS (
  SELECT 'subject' AS field_name, triple_id, unnest(regexp_extract_all(subject, '[\p{L}\p{N}]+')) AS term FROM triples
  UNION ALL SELECT 'obj', triple_id, unnest(regexp_extract_all(obj, '[\p{L}\p{N}]+')) FROM triples
  UNION ALL SELECT 'relation', triple_id, trim(relation) FROM triples WHERE trim(relation) <> ''
), counts AS (
  SELECT field_name, CASE WHEN field_name = 'relation' THEN term ELSE lower(term) END AS term,
         count(*) AS occurrences, count(DISTINCT triple_id) AS records
  FROM runs GROUP BY 1, 2
), marked AS (
  SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.08 * (SELECT count(*) FROM triples) THEN 'common' ELSE '' END AS mark
  FROM counts
)
"""
QUERIES = {"p2_found": p2_found, "p2_terms": p2_terms}
ORACLES = {
    "p2_found": _TERMS + "SELECT field_name, term, mark FROM marked WHERE mark <> ''",
    "p2_terms": _TERMS + "SELECT field_name, term, occurrences, records, mark FROM marked",
}
