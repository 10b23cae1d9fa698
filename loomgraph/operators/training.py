"""Sequence data for a token classifier: label ids, chunks, splits, weights, alignment and scoring.

Sequences are ``seq_id, tokens array<string>, labels array<string>``. Random
choices of the original become hashes of the ids with a seed, so they are the
same on any cluster; counts and thresholds are exact.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chunked(seqs: DataFrame, most: int = 256) -> DataFrame:
    """Consecutive windows of ``most`` tokens: ``seq_id, chunk_no, tokens, labels``; an empty sequence gives one empty chunk."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("tokens") - 1), F.lit(most))
    return seqs.select("seq_id", "tokens", "labels", F.posexplode(starts).alias("chunk_no", "at")).select(
        "seq_id", "chunk_no", F.slice("tokens", F.col("at") + 1, F.lit(most)).alias("tokens"), F.slice("labels", F.col("at") + 1, F.lit(most)).alias("labels")
    )


def length_stats(seqs: DataFrame, limit: int = 256) -> DataFrame:
    n = F.size("tokens")
    return seqs.agg(
        F.min(n).cast("bigint").alias("least"), F.round(F.avg(n), 6).alias("mean"), F.max(n).cast("bigint").alias("most"),
        F.round(F.percentile(n, F.lit(0.95)), 6).alias("p95"), F.round(F.avg((n > limit).cast("double")), 6).alias("share_over"),
    )


def label_ids(seqs: DataFrame) -> DataFrame:
    """``label, label_id``: O first, then by code point. The label set is small; it is numbered in one window."""
    distinct = seqs.select(F.explode("labels").alias("label")).unionByName(seqs.sparkSession.sql("select 'O' as label")).distinct()
    return distinct.select("label", (F.row_number().over(Window.orderBy(F.col("label") != "O", "label")) - 1).alias("label_id"))


def encoded(seqs: DataFrame, ids: DataFrame) -> DataFrame:
    """Training records with integer tags; the label map travels as one constant row."""
    mapping = ids.agg(F.map_from_entries(F.collect_list(F.struct("label", "label_id"))).alias("m"))
    return seqs.crossJoin(F.broadcast(mapping)).select("seq_id", "tokens", F.transform("labels", lambda x: F.try_element_at("m", x)).alias("ner_tags"))


def split(chunks: DataFrame, keys: tuple[str, ...] = ("seq_id", "chunk_no"), test: float = 0.05, val: float = 0.10, seed: int = 42) -> DataFrame:
    """Exact-size test, validation and train parts in an order hashed from the keys.

    Ranks come from range partitions and their sizes, not from one sorted partition.
    """
    from loomgraph.plans.runtime import materialize

    hashed = chunks.withColumn("_h", F.xxhash64(F.lit(seed), *keys))
    ranged = materialize(hashed.repartitionByRange("_h", *keys).sortWithinPartitions("_h", *keys).withColumn("_m", F.monotonically_increasing_id()))
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy(F.shiftright("_m", 33).alias("p")).count().collect())
    total, base = 0, []
    for p, n in sizes:
        base.append((p, total))
        total += n
    offsets = chunks.sparkSession.createDataFrame(base or [(0, 0)], "_p bigint, _o bigint")
    n_test, n_val = int(total * test), int(total * val)
    rank = F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1)
    part = F.when(rank < n_test, "test").when(rank < n_test + n_val, "validation").otherwise("train")
    return ranged.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(offsets), "_p").withColumn("part", part).drop("_h", "_m", "_p", "_o")


def last_part(label: Column) -> Column:
    return F.element_at(F.split(label, "-"), -1)


def type_shares(seqs: DataFrame) -> DataFrame:
    """Tokens of each type (B and I together) and their share of all typed tokens."""
    n = seqs.select(F.explode("labels").alias("l")).where("l <> 'O'").groupBy(last_part(F.col("l")).alias("etype")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("etype", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def rare_types(seqs: DataFrame, below: float = 0.05) -> DataFrame:
    return type_shares(seqs).where(F.col("share") < below).select("etype")


def weighted(seqs: DataFrame, rare: DataFrame, weight: float = 3.0) -> DataFrame:
    """Sequences with ``has_rare`` and ``weight``; the rare types are one small row."""
    one = rare.agg(F.collect_set("etype").alias("rare"))
    has = F.arrays_overlap(F.transform(F.filter("labels", lambda x: x != "O"), last_part), F.col("rare"))
    return seqs.crossJoin(F.broadcast(one)).withColumn("has_rare", F.coalesce(has, F.lit(False))).drop("rare").withColumn("weight", F.when(F.col("has_rare"), weight).otherwise(1.0))


def effective_rare_pct(n_rare: Column, n: Column, weight: float = 3.0) -> Column:
    return n_rare * weight / (n + n_rare * (weight - 1)) * 100


def resampled(seqs: DataFrame, seed: int = 42) -> DataFrame:
    """As many draws as there are sequences, with replacement, in proportion to ``weight``.

    Each sequence owns a stretch of the unit line as long as its weight; draw k
    falls at (k + u_k)/n, so the draws a sequence gets follow from its own
    stretch alone and no draw table is joined. Running sums use range partitions.
    """
    from loomgraph.plans.runtime import materialize

    ranged = materialize(seqs.repartitionByRange("seq_id").withColumn("_p", F.spark_partition_id()))
    sums = sorted((r[0], r[1], r[2]) for r in ranged.groupBy("_p").agg(F.sum("weight"), F.count(F.lit(1))).collect())
    total, n, base = sum(s for _, s, _ in sums), sum(c for _, _, c in sums), []
    run = 0.0
    for p, s, _ in sums:
        base.append((p, run))
        run += s
    offsets = seqs.sparkSession.createDataFrame(base or [(0, 0.0)], "_p int, _o double")
    upto = F.sum("weight").over(Window.partitionBy("_p").orderBy("seq_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.join(F.broadcast(offsets), "_p").withColumn("_b", F.col("_o") + upto)
    scale = F.lit(float(n) / total if total else 0.0)
    lo, hi = (F.col("_b") - F.col("weight")) * scale, F.col("_b") * scale
    tick = lambda k: k + (F.pmod(F.xxhash64(F.lit(seed), k), F.lit(1_000_003)) / 1_000_003.0)
    ks = F.filter(F.sequence(F.greatest(F.lit(0), F.floor(lo) - 1), F.floor(hi) + 1), lambda k: (tick(k) >= lo) & (tick(k) < hi) & (k < n))
    return placed.select("seq_id", F.size(ks).alias("draws")).where("draws > 0")


def class_weights(seqs: DataFrame, ids: DataFrame, low: float = 0.1, high: float = 10.0) -> DataFrame:
    """sqrt(total / (classes x count)), clipped, then divided by the mean; labels that do not occur count as one."""
    n = seqs.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    counts = ids.join(n, "label", "left").fillna(0, ["n"])
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes"))
    raw = F.sqrt(F.col("total") / (F.col("classes") * F.greatest(F.col("n"), F.lit(1))))
    clipped = counts.crossJoin(F.broadcast(total)).withColumn("w", F.least(F.greatest(raw, F.lit(low)), F.lit(high)))
    mean = clipped.agg(F.avg("w").alias("mean"))
    return clipped.crossJoin(F.broadcast(mean)).select("label", "label_id", "n", F.round(F.col("w") / F.col("mean"), 6).alias("weight"))


def argmax(values: Column) -> Column:
    """Place of the first greatest value."""
    return F.array_position(values, F.array_max(values)) - 1


def drop_ignored(predicted: Column, gold: Column, ignored: int = -100) -> Column:
    """Pairs (predicted, gold) at the places where gold counts."""
    return F.filter(F.arrays_zip(predicted.alias("p"), gold.alias("g")), lambda x: x["g"] != ignored)


def word_ids(words: Column, pieces: Callable[[str], int], most: int = 256) -> Column:
    """Word of each subword, null for the two marks at the ends; cut so that all fits in ``most``. ``pieces`` counts a word's subwords."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batch: pd.Series) -> pd.Series:
        def one(ws):
            flat = [i for i, w in enumerate(ws if ws is not None else []) for _ in range(max(1, pieces(w)))]
            return [None, *flat[: most - 2], None]

        return batch.map(one)

    return ids(words)


def align_labels(ids: Column, tags: Column, ignored: int = -100) -> Column:
    """Tag of each subword: the word's on its first subword, ``ignored`` on the others and on the end marks."""
    def one(w: Column, i: Column) -> Column:
        before = F.when(i > 0, F.try_element_at(ids, F.greatest(i, F.lit(1))))
        first = w.isNotNull() & ~F.coalesce(before == w, F.lit(False))
        return F.when(first, F.try_element_at(tags, w + 1)).otherwise(F.lit(ignored))

    return F.transform(ids, one)


def entity_spans(seqs: DataFrame, labels: str) -> DataFrame:
    """``seq_id, etype, start, end`` of the entities; an I- after another type or O opens one too."""
    pos = seqs.select("seq_id", F.posexplode(labels).alias("i", "label"))
    w = Window.partitionBy("seq_id").orderBy("i")
    kind = F.when(F.col("label").rlike("^[BI]-"), F.substring("label", 3, 1000))
    marked = pos.withColumn("t", kind).withColumn("prev", F.lag("t").over(w))
    opens = F.col("t").isNotNull() & (F.col("label").startswith("B-") | ~F.coalesce(F.col("prev") == F.col("t"), F.lit(False)))
    runs = marked.withColumn("run", F.sum(opens.cast("int")).over(w)).where("t is not null")
    return runs.groupBy("seq_id", "run").agg(F.first("t").alias("etype"), F.min("i").alias("start"), (F.max("i") + 1).alias("end")).drop("run")


def scores(seqs: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each type and over all (etype ``micro``), entities compared by type and place."""
    g, p = entity_spans(seqs, gold), entity_spans(seqs, predicted)
    hit = g.join(p, ["seq_id", "etype", "start", "end"], "left_semi")
    count = lambda df, name: df.groupBy("etype").agg(F.count(F.lit(1)).alias(name))
    by = count(g, "support").join(count(p, "found"), "etype", "full_outer").join(count(hit, "tp"), "etype", "left").fillna(0, ["support", "found", "tp"])
    every = by.unionByName(by.agg(F.lit("micro").alias("etype"), F.sum("support").alias("support"), F.sum("found").alias("found"), F.sum("tp").alias("tp")))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    pr, rc = safe(F.col("tp"), F.col("found")), safe(F.col("tp"), F.col("support"))
    return every.select("etype", "support", "found", "tp", F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(safe(2 * pr * rc, pr + rc), 6).alias("f1"))


def token_accuracy(seqs: DataFrame, gold: str, predicted: str) -> DataFrame:
    pairs = seqs.select(F.explode(F.arrays_zip(F.col(gold).alias("g"), F.col(predicted).alias("p"))).alias("x"))
    return pairs.agg(F.round(F.avg((F.col("x.g") == F.col("x.p")).cast("double")), 6).alias("accuracy"))


def epoch_losses(logs: DataFrame, steps_per_epoch: int) -> DataFrame:
    """Mean training loss of each epoch from step logs; steps without a number are left out."""
    good = logs.where(F.col("loss").isNotNull() & ~F.isnan("loss"))
    return good.groupBy(F.floor((F.col("step") - 1) / steps_per_epoch).alias("epoch")).agg(F.round(F.avg("loss"), 6).alias("loss"))
