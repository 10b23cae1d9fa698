"""Triple algebra: cleaning, filtering, dedup with representative, edge collapse, node typing, statistics.

All "first" and "last" choices follow the explicit ordinal ``ord``; null or
blank ends, self loops and unparsable numbers have the results stated at each
function. Hot keys are pre-aggregated on the map side by the built-in
aggregates used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as tx


def _have(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def clean(triples: DataFrame, ordinal: str = "triple_id") -> DataFrame:
    """``ord, subject, subject_type, relation, object, object_type, weight, frequency, source_id``.

    ``object``/``obj`` are aliases, the first filled one counts; empty ends and
    self loops are dropped; blank types become UNKNOWN, a blank relation
    LIEN_QUAN; weight falls back to confidence, then 1; frequency to 1.
    """
    get = lambda n: _have(triples, n)
    out = triples.select(
        F.col(ordinal).alias("ord"),
        tx.strip(F.coalesce(F.nullif(get("subject"), F.lit("")), F.lit(""))).alias("subject"),
        tx.strip(F.coalesce(F.nullif(get("object"), F.lit("")), F.nullif(get("obj"), F.lit("")), F.lit(""))).alias("object"),
        tx.first_filled(get("subject_type"), default="UNKNOWN").alias("subject_type"),
        tx.first_filled(get("object_type"), get("obj_type"), default="UNKNOWN").alias("object_type"),
        tx.first_filled(get("relation"), default="LIEN_QUAN").alias("relation"),
        tx.as_double(get("weight"), tx.as_double(get("confidence"), F.lit(1.0))).alias("weight"),
        tx.as_long(get("frequency"), F.lit(1).cast("bigint")).alias("frequency"),
        get("source_id").try_cast("bigint").alias("source_id"),
    )
    return out.where("subject <> '' and object <> '' and subject <> object")


def valid(triples: DataFrame, least: float = 0.5) -> DataFrame:
    """Triples of enough confidence whose two ends are real names."""
    return triples.where((F.col("confidence") >= least) & tx.is_valid_entity(F.col("subject")) & tx.is_valid_entity(F.col("obj")))


def dedup(triples: DataFrame, least: float = 0.5, least_freq: int = 1) -> DataFrame:
    """One row a (subject, relation, obj): how often it occurs and the first occurrence of the greatest confidence."""
    best = F.struct("confidence", (-F.col("triple_id")).alias("ord"), "subject_type", "obj_type", "source_id", "source_text")
    grouped = valid(triples, least).groupBy("subject", "relation", "obj").agg(
        F.count(F.lit(1)).alias("frequency"), F.max(best).alias("best"), F.min("triple_id").alias("ord")
    )
    return grouped.where(F.col("frequency") >= least_freq).select(
        "ord", "subject", F.col("best.subject_type").alias("subject_type"), "relation", "obj", F.col("best.obj_type").alias("obj_type"),
        F.col("best.confidence").alias("confidence"), "frequency",
        F.round(F.col("frequency") * F.col("best.confidence"), 4).alias("weight"),
        F.col("best.source_id").alias("source_id"), F.substring("best.source_text", 1, 120).alias("source_text"),
    )


def node_types(edges: DataFrame, upgrade: bool, src: str = "subject", dst: str = "object", src_type: str = "subject_type", dst_type: str = "object_type", among: DataFrame | None = None) -> DataFrame:
    """``node, entity_type, ord``: type at first sight; with ``upgrade``, the first type other than UNKNOWN if there is one. ``among``: only nodes with their hash in its ``id``."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col(src).alias("node"), F.col(src_type).alias("t"), (F.col("ord") * 2).alias("o")),
                F.struct(F.col(dst).alias("node"), F.col(dst_type).alias("t"), (F.col("ord") * 2 + 1).alias("o")),
            )
        ).alias("e")
    ).select("e.*")
    if among is not None:
        ends = ends.withColumn("id", F.xxhash64("node")).join(among.select("id"), "id", "left_semi")
    first = F.min(F.struct("o", "t"))["t"]
    if upgrade:
        known = F.min(F.when(F.col("t") != "UNKNOWN", F.struct("o", "t")))["t"]
        first = F.coalesce(known, F.lit("UNKNOWN"))
    return ends.groupBy("node").agg(first.alias("entity_type"), F.min("o").alias("ord"))


def collapse(clean_triples: DataFrame) -> DataFrame:
    """One directed edge a pair: weights and frequencies summed, triples counted, relations as a map of counts."""
    by_relation = clean_triples.groupBy("subject", "object", "relation").agg(
        F.sum("weight").alias("weight"), F.sum("frequency").alias("frequency"), F.count(F.lit(1)).alias("n")
    )
    return by_relation.groupBy("subject", "object").agg(
        F.sum("weight").alias("weight"), F.sum("frequency").alias("frequency"), F.sum("n").alias("triple_count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("relation", "n")))).alias("relations"),  # one entry a relation
    )


def collapse_export(final: DataFrame) -> DataFrame:
    """One edge a pair for export: relations joined by '|', greatest confidence, summed frequency and weight."""
    return final.groupBy("subject", "obj").agg(
        tx.concat_sorted(F.collect_set("relation")).alias("relation"), F.round(F.max("confidence"), 4).alias("confidence"),
        F.sum("frequency").alias("frequency"), F.round(F.sum("weight"), 4).alias("weight"),
    )


def export_rows(final: DataFrame) -> DataFrame:
    """The ten export columns, numbers to four digits."""
    return final.select(
        "subject", "subject_type", "relation", F.col("obj").alias("object"), F.col("obj_type").alias("object_type"),
        F.round("confidence", 4).alias("confidence"), "frequency", F.round("weight", 4).alias("weight"), "source_id", "source_text",
    )


def coverage(final: DataFrame, n_articles: int) -> DataFrame:
    """Sources that still stand behind a kept triple, and their share of all articles."""
    share = F.round(F.count_distinct("source_id") / F.lit(float(n_articles)), 6) if n_articles else F.lit(0.0)
    return final.agg(F.count_distinct("source_id").alias("sources"), share.alias("share"))


def confidence_stats(final: DataFrame) -> DataFrame:
    return final.agg(
        F.round(F.avg("confidence"), 6).alias("mean"), F.round(F.median("confidence"), 6).alias("median"), F.min("confidence").alias("least")
    )


def counts_by(df: DataFrame, key: str) -> DataFrame:
    """Count of each value, the most common first, ties by value."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def metadata(final: DataFrame, model: str, least_score: float, least_confidence: float) -> DataFrame:
    """The metadata record of a triples document."""
    ends = F.array_union(F.collect_set("subject_type"), F.collect_set("obj_type"))
    nodes = final.select(F.explode(F.array("subject", "obj")).alias("node")).agg(F.count_distinct("node").alias("total_nodes"))
    pairs = final.agg(
        F.count(F.lit(1)).alias("total_triples"), F.count(F.lit(1)).alias("total_edges"),
        F.sort_array(F.collect_set("relation")).alias("relation_types"), F.sort_array(ends).alias("entity_types"),
    )
    return pairs.crossJoin(nodes).select(  # two single rows
        F.lit(model).alias("model"), "total_triples", "total_nodes", "total_edges", "relation_types", "entity_types",
        F.lit(least_score).alias("min_ner_score"), F.lit(least_confidence).alias("min_confidence"),
    )
