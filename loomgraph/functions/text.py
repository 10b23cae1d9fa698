"""Scalar text functions as Column expressions; Python only for canonical composition, and only where a text needs it."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.plans import rules

#: texts without any of these are in composed form already
_MAY_COMPOSE = r"[\u0300-\u036f\u0653-\u0655\u093c\u09be\u09d7\u0b3e\u0b56\u0b57\u0bbe\u0bd7\u3099\u309aᅡ-ᅵᆨ-ᇂΩKÅ豈-\ufaffक़-य़]"


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Canonical composition; null stays null. Only texts that may change are sent to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(_MAY_COMPOSE), text)), text)


def strip(text: Column, also: str = "") -> Column:
    """Without leading and trailing white space of any script (Spark's trim knows blanks only)."""
    return F.regexp_replace(text, rf"(?U)^[\s{also}]+|[\s{also}]+$", "")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s{2,}", " ")


def normalize_text(text: Column, char_map: dict[str, str] = rules.CHAR_MAP, compose: bool = True) -> Column:
    """Composed, mapped characters, runs of blanks and tabs collapsed (line breaks kept), stripped; null gives ''."""
    out = F.coalesce(nfc(text) if compose else text, F.lit(""))
    single = {k: v for k, v in char_map.items() if len(v) == 1}
    gone = [k for k, v in char_map.items() if not v]
    out = F.translate(out, "".join(single) + "".join(gone), "".join(single.values()))
    for key, value in char_map.items():
        if len(value) > 1:
            out = F.replace(out, F.lit(key), F.lit(value))
    return strip(F.regexp_replace(out, "[ \t]{2,}", " "))


def lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    """Constant dictionary as a map literal: one hash lookup, no join."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def normalize_entity(text: Column, aliases: dict[str, str] = rules.ALIASES, low: int = 2, high: int = 80, compose: bool = True) -> Column:
    """Canonical surface of an entity, '' for noise: blank, too short or long, only digits and marks."""
    blank = text.isNull() | ~text.rlike(r"(?U)\S")
    return F.when(blank, "").otherwise(_entity_name(_entity_base(nfc(text) if compose else text), aliases, low, high))


def _entity_base(text: Column) -> Column:
    return F.regexp_replace(squeeze(strip(text)), "^[.,;:!?\"']+|[.,;:!?\"']+$", "")


def _entity_name(base: Column, aliases: dict[str, str] = rules.ALIASES, low: int = 2, high: int = 80) -> Column:
    noise = (F.length(base) < low) | (F.length(base) > high) | base.rlike(r"(?U)^[\d\s.,;:\-/]+$")
    alias = lookup(F.lower(base), aliases, F.lit(None).cast("string"))
    return F.when(alias.isNotNull(), alias).when(noise, "").otherwise(base)


def entity_name(text: Column) -> Column:
    """:func:`normalize_entity` of composed text for use inside array functions, where nothing is shared: the base is worked out once."""
    return F.coalesce(F.element_at(F.transform(F.array(_entity_base(text)), lambda b: _entity_name(b)), 1), F.lit(""))


def canonicalize(surface: Column, table: dict[str, str] = rules.CANONICAL) -> Column:
    """Canonical name by exact, then stripped lookup; unknown surfaces stay."""
    return lookup(surface, table, lookup(strip(surface), table, surface))


def is_valid_entity(text: Column) -> Column:
    bare = strip(text)
    return F.coalesce((F.length(bare) > 1) & ~text.rlike(r"(?U)^[\d\s.,;:\-/]+$"), F.lit(False))


def as_double(value: Column, default: Column) -> Column:
    return F.coalesce(value.try_cast("double"), default)


def as_long(value: Column, default: Column) -> Column:
    """Integer part of a number in any notation, else the default."""
    return F.coalesce(value.try_cast("double").try_cast("bigint"), default)


def first_filled(*values: Column, default: str) -> Column:
    """First value that is neither null nor '', stripped; the default if that leaves nothing."""
    chosen = F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(default))
    return F.coalesce(F.nullif(strip(chosen), F.lit("")), F.lit(default))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the white-space token sets, case ignored; 0 if either is empty."""
    return bag_jaccard(token_set(a), token_set(b))


def bag_jaccard(x: Column, y: Column) -> Column:
    """Jaccard similarity of two token sets."""
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    )


def split_pieces(text: Column, marks: str) -> Column:
    return F.split(text, rf"(?U)(?<=[{marks}])\s+")


def pack_sentences(text: Column, most: int = 600, least: int = 5) -> Column:
    """Sentences packed greedily into pieces of at most ``most`` characters; longer ones cut hard.

    A piece shorter than ``least`` is dropped. Null and blank give an empty array.
    """
    state = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))
    flush = lambda out, buf: F.when(F.length(strip(buf)) > 0, F.concat(out, F.array(strip(buf)))).otherwise(out)
    cuts = lambda s: F.filter(
        F.transform(F.sequence(F.lit(0), F.ceil(F.length(s) / most).cast("int") - 1), lambda i: strip(F.substring(s, i * most + 1, F.lit(most)))),
        lambda p: F.length(p) > 0,
    )

    def step(acc: Column, sent: Column) -> Column:
        fits = F.length(acc["buf"]) + F.length(sent) + 1 <= most
        huge = F.length(sent) > most
        joined = strip(F.concat(acc["buf"], F.lit(" "), sent))
        flushed = flush(acc["out"], acc["buf"])
        return F.when(fits, F.struct(joined.alias("buf"), acc["out"].alias("out"))).when(
            huge, F.struct(F.lit("").alias("buf"), F.concat(flushed, cuts(sent)).alias("out"))
        ).otherwise(F.struct(sent.alias("buf"), flushed.alias("out")))

    folded = F.aggregate(split_pieces(strip(F.coalesce(text, F.lit(""))), ".!?;"), state, step, lambda acc: flush(acc["out"], acc["buf"]))
    return F.filter(folded, lambda p: F.length(p) >= least)


def model_chunks(text: Column, most: int = 1500) -> Column:
    """Chunks for a model with their start offsets; one sentence is never cut, one separator is assumed between chunks."""
    state = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, sent: Column) -> Column:
        fits = (F.length(acc["buf"]) > 0) & (F.length(acc["buf"]) + F.length(sent) + 1 <= most)
        return (
            F.when(F.length(acc["buf"]) == 0, F.struct(sent.alias("buf"), acc["out"].alias("out")))
            .when(fits, F.struct(F.concat(acc["buf"], F.lit(" "), sent).alias("buf"), acc["out"].alias("out")))
            .otherwise(F.struct(sent.alias("buf"), F.concat(acc["out"], F.array(acc["buf"])).alias("out")))
        )

    chunks = F.aggregate(
        split_pieces(text, ".!?"), state, step,
        lambda acc: F.when(F.length(acc["buf"]) > 0, F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"]),
    )
    starts = lambda i, cs: F.aggregate(F.slice(cs, F.lit(1), i), F.lit(0), lambda n, c: n + F.length(c) + 1)
    return F.transform(chunks, lambda c, i: F.struct(c.alias("chunk"), starts(i, chunks).alias("start")))


def concat_sorted(values: Column, sep: str = "|") -> Column:
    return F.array_join(F.sort_array(values), sep)


def any_in(text: Column, needles: Iterable[str]) -> Column:
    """Whether any of the words stands in ``text``."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | text.contains(needle)
    return hit
