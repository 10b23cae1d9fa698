"""Providers of entities: precomputed tables, rules, or a model of the caller's.

Contract: rows with ``row_id, field, sent_no, text`` get a column ``entities
array<struct<text,etype,score>>``; null and blank texts get an empty array.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import text as tx
from loomgraph.operators import spans as sp

_LOADED: dict[str, Callable] = {}  # models of this Python worker
ENTITIES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("etype", T.StringType()), T.StructField("score", T.DoubleType())]))


def sentence_rows(articles: DataFrame, fields: tuple[str, ...] = ("title", "content", "text"), most: int = 600) -> DataFrame:
    """Articles as sentence packs: ``row_id, field, field_no, sent_no, text``."""
    present = [f for f in fields if f in articles.columns]
    parts = F.array(*[F.struct(F.lit(i).alias("field_no"), F.lit(f).alias("field"), tx.pack_sentences(F.col(f), most).alias("packs")) for i, f in enumerate(present)])
    rows = articles.select(F.col("id").alias("row_id"), F.explode(parts).alias("f")).select("row_id", "f.*")
    return rows.select("row_id", "field_no", "field", F.posexplode("packs").alias("sent_no", "text"))


def kept(entities: Column, least: float = 0.70) -> Column:
    """Entities of enough score with a label and a text, scores to four digits."""
    good = F.filter(entities, lambda e: (e["score"] >= least) & ~F.coalesce(e["etype"], F.lit("")).isin("", "O") & (F.length(tx.strip(e["text"])) > 0))
    return F.transform(good, lambda e: F.struct(tx.strip(e["text"]).alias("text"), e["etype"].alias("etype"), F.round(e["score"], 4).alias("score")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _compose_all(batch: pd.Series) -> pd.Series:
    return batch.map(lambda ts: [None if t is None else unicodedata.normalize("NFC", t) for t in ts], na_action="ignore")


#: marked so that no filter is pushed below it and its calls are never repeated
_compose_all = _compose_all.asNondeterministic()


def composed(df: DataFrame, column: str = "entities") -> DataFrame:
    """Entity texts in composed form; only arrays that may change go to Python."""
    texts = F.transform(column, lambda e: e["text"])
    some = F.exists(texts, lambda t: t.rlike(tx._MAY_COMPOSE))
    df = df.withColumn("_t", F.coalesce(_compose_all(F.when(some, texts)), texts))
    zipped = F.zip_with(column, "_t", lambda e, t: F.struct(t.alias("text"), e["etype"].alias("etype"), e["score"].alias("score")))
    return df.withColumn(column, zipped).drop("_t")


def normalized(df: DataFrame, column: str = "entities") -> DataFrame:
    """Entities with canonical surfaces, emptied ones dropped; ``n_changed`` and ``n_dropped`` count what happened; rows without any go."""
    df = composed(df, column)
    named = F.transform(column, lambda e: F.struct(e["text"].alias("raw"), tx.normalize_entity(e["text"], compose=False).alias("text"), e["etype"].alias("etype"), e["score"].alias("score")))
    out = df.withColumn("_n", named).withColumns(
        {
            "n_changed": F.size(F.filter("_n", lambda e: (e["text"] != "") & (e["text"] != e["raw"]))),
            "n_dropped": F.size(F.filter("_n", lambda e: e["text"] == "")),
            column: F.transform(F.filter("_n", lambda e: e["text"] != ""), lambda e: F.struct(e["text"].alias("text"), e["etype"].alias("etype"), e["score"].alias("score"))),
        }
    )
    return out.drop("_n").where(F.size(column) > 0)


def from_table(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Entities precomputed in a table with the same keys."""
    found = known.groupBy(*keys).agg(F.collect_list(F.struct("text", "etype", "score")).alias("entities"))  # the entities of one text
    return rows.join(found, keys, "left").withColumn("entities", F.coalesce("entities", F.array().cast(ENTITIES)))


def from_rules(rows: DataFrame, entries: list[tuple[str, str, str, bool]]) -> DataFrame:
    """Entities by patterns and dictionary, deterministic, score 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = sp.resolve_overlaps(F.concat(sp.regex_spans(text), sp.dictionary_spans(text, entries)))
    cut = lambda s: F.struct(F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text"), s["etype"].alias("etype"), s["score"].alias("score"))
    return rows.withColumn("_spans", found).withColumn("entities", F.transform("_spans", cut)).drop("_spans")


def from_model(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[list[dict]]]], batch: int = 32) -> DataFrame:
    """Entities by a model: ``load`` runs once a worker and gives a function from texts to entity dicts; a failing batch gives none, and ``error`` says why."""
    key = uuid.uuid4().hex
    schema = T.StructType([*rows.schema.fields, T.StructField("entities", ENTITIES), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        infer = _LOADED.get(key) or _LOADED.setdefault(key, load())
        for pdf in batches:
            texts, out, errors = pdf["text"].fillna("").tolist(), [], []
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    out += infer(part)
                    errors += [None] * len(part)
                except Exception as e:  # one bad batch must not end the pass
                    out += [[] for _ in part]
                    errors += [repr(e)] * len(part)
            yield pdf.assign(error=errors, entities=[[(e["text"], e["etype"], float(e["score"])) for e in es] for es in out])

    return rows.mapInPandas(run, schema)
