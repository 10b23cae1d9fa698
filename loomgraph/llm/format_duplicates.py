"""Duplicates hidden by formatting: canonical form, 128-bit hash, map-side counts, collision check.

Method: characters, case, blanks and punctuation are canonicalized inside the
JVM, undirected relations get their two ends in sorted order, the canonical key
is hashed to 128 bits (two independently seeded xxhash64), and min(id)/count
are aggregated on the hash, which Spark combines on the map side, so a key held
by a third of all rows leaves every task as a single row. A third, independent
digest travels along; a group in which it differs holds a hash collision, and the
rows of such groups are read again and grouped by the whole canonical key.

Joining copies back to their group is split: groups holding at least 1/4096 of
all rows (at most 4096 of them, whatever the data) are broadcast, the others
are joined by shuffle, whose partitions are split by their bytes when they are skewed.

Defined results: null or blank subject, relation or obj: no case. Null
``source_id`` equals null only. Text without any letter or digit canonicalizes
to the empty string and such texts equal each other. Ties and repeated rows:
the smallest id is kept. Empty input gives an empty result; extra columns are
ignored. Unreadable JSON lines give no record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.plans.runtime import materialize, table

UNDIRECTED = ("HỢP_TÁC",)
HOT_SHARE = 4096

#: one mark directly between two digits is kept ($1), every other mark or blank goes
MARKS = r"(?U)(?<=\p{Nd})([^\p{L}\p{N}\s])(?=\p{Nd})|[^\p{L}\p{N}]+"

_LINE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("subject", "relation", "obj", "object", "source_id", "_bad")]
)


def canonical(text: Column) -> Column:
    """Lower case without blanks and marks; a single mark between two digits stays."""
    return F.lower(F.regexp_replace(text, MARKS, "$1"))


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Raw JSON lines to triple records; keys in any order, ``object`` as another name of ``obj``."""
    parsed = F.from_json("line", _LINE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return (
        lines.select("triple_id", parsed.alias("r"))
        .where("r is not null and r._bad is null")
        .select(
            "triple_id", "r.subject", "r.relation", F.coalesce("r.obj", "r.object").alias("obj"),
            F.expr("try_cast(r.source_id as bigint)").alias("source_id"),
        )
    )


def keyed(records: DataFrame) -> DataFrame:
    """``triple_id, h1, h2, check`` of every record that is a case."""
    a, b = canonical(F.col("subject")), canonical(F.col("obj"))
    swap = F.col("relation").isin(*UNDIRECTED) & (a > b)
    ends = records.where(~blank(F.col("subject")) & ~blank(F.col("obj")) & ~blank(F.col("relation"))).select(
        "triple_id", "relation", "source_id",
        F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"),
    )
    key = [F.col("relation"), F.coalesce(F.col("source_id").cast("string"), F.lit("\u0000")), F.col("a"), F.lit("\u0001"), F.col("b")]
    return ends.select(
        "triple_id",
        F.xxhash64(F.lit("left"), *key).alias("h1"),
        F.xxhash64(F.lit("right"), *key).alias("h2"),
        F.xxhash64(F.lit("check"), *reversed(key)).alias("check"),
        "relation", "source_id", "a", "b",
    )


def read_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["triple_id", "subject", "relation", "obj", "source_id"]
    return table(spark, sf_dir, "triples").select(*columns).unionByName(parse_lines(table(spark, sf_dir, "triple_lines")))


def duplicate_groups(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys, groups): keys has one row a record (triple_id, h1, h2, part, check); groups kept_id and copies per 128-bit key (and part of it, after a collision)."""
    keys = keyed(records)
    slim = materialize(keys.select("triple_id", "h1", "h2", F.lit(0).cast("bigint").alias("part"), "check"))
    count = [F.min("triple_id").alias("kept_id"), F.count(F.lit(1)).alias("copies")]
    groups = slim.groupBy("h1", "h2", "part").agg(*count, F.min("check").alias("check"), F.max("check").alias("check_max"))
    collided = materialize(groups.where("check <> check_max").select("h1", "h2"))
    if not collided.isEmpty():  # practically never: the whole key parts what the hashes do not
        whole = ["h1", "h2", "relation", "source_id", "a", "b"]
        mixed = keys.join(collided, ["h1", "h2"], "left_semi")
        parts = mixed.groupBy(*whole).agg(F.min("triple_id").alias("part"))  # the smallest id tells one key from another
        same = [F.col(f"k.{c}").eqNullSafe(F.col(f"p.{c}")) for c in whole]
        apart = mixed.alias("k").join(parts.alias("p"), same).select("k.triple_id", "k.h1", "k.h2", "p.part", "k.check")
        slim = materialize(slim.join(collided, ["h1", "h2"], "left_anti").select(*slim.columns).unionByName(apart))
        groups = slim.groupBy("h1", "h2", "part").agg(*count)
    return slim, groups.select("h1", "h2", "part", "kept_id", "copies").where("copies > 1")


def copies(records: DataFrame) -> DataFrame:
    """``kept_id, copy_id``: one row for every record that is not the first of its group."""
    slim, groups = duplicate_groups(records)
    least = max(2, slim.count() // HOT_SHARE)
    hot = groups.where(F.col("copies") >= least)  # at most HOT_SHARE rows
    cold = groups.where(F.col("copies") < least)
    group = ["h1", "h2", "part"]
    parts = [slim.join(F.broadcast(hot), group), slim.join(cold, group)]
    pairs = parts[0].select("kept_id", "triple_id").unionByName(parts[1].select("kept_id", "triple_id"))
    return pairs.where("triple_id <> kept_id").select("kept_id", F.col("triple_id").alias("copy_id"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(read_records(spark, sf_dir))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a repeated fact: the record kept and its number of copies (itself included)."""
    return duplicate_groups(read_records(spark, sf_dir))[1].select("kept_id", "copies")


def _canonical_sql(x: str) -> str:
    """Character by character: letters and digits in lower case, and a mark between two digits."""
    return rf"""lower(array_to_string(list_transform(string_split({x}, ''), lambda c, i: CASE WHEN regexp_matches(c, '[\p{{L}}\p{{N}}]') THEN c WHEN regexp_matches(c, '[\s\p{{Z}}]') THEN ''
      WHEN regexp_matches(coalesce(string_split({x}, '')[i - 1], ''), '\p{{Nd}}') AND i > 1 AND regexp_matches(coalesce(string_split({x}, '')[i + 1], ''), '\p{{Nd}}') THEN c ELSE '' END), ''))"""


_KEYED_SQL = rf"""
WITH j AS (SELECT triple_id, CASE WHEN json_valid(line) THEN line::JSON END AS j FROM triple_lines),
r AS (SELECT triple_id, subject, relation, obj, source_id FROM triples UNION ALL
  SELECT triple_id, json_extract_string(j, '$.subject'), json_extract_string(j, '$.relation'), coalesce(json_extract_string(j, '$.obj'), json_extract_string(j, '$.object')), TRY_CAST(json_extract_string(j, '$.source_id') AS BIGINT) FROM j WHERE j IS NOT NULL),
c AS (SELECT triple_id, relation, source_id, {_canonical_sql("subject")} AS a, {_canonical_sql("obj")} AS b FROM r
  WHERE regexp_matches(subject, '[^\s\p{{Z}}]') AND regexp_matches(obj, '[^\s\p{{Z}}]') AND regexp_matches(relation, '[^\s\p{{Z}}]')),
k AS (SELECT triple_id, relation, source_id, CASE WHEN relation IN ('{"', '".join(UNDIRECTED)}') AND a > b THEN b ELSE a END AS a, CASE WHEN relation IN ('{"', '".join(UNDIRECTED)}') AND a > b THEN a ELSE b END AS b FROM c),
g AS (SELECT *, min(triple_id) OVER w AS kept_id, count(*) OVER w AS copies FROM k WINDOW w AS (PARTITION BY relation, source_id, a, b))
"""
QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}
ORACLES = {
    "p1_found": _KEYED_SQL + "SELECT kept_id, triple_id AS copy_id FROM g WHERE triple_id <> kept_id",
    "p1_groups": _KEYED_SQL + "SELECT DISTINCT kept_id, copies FROM g WHERE copies > 1",
}
