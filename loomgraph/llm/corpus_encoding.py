"""Encoding of a corpus with a public byte-level BPE tokenizer by tree concatenation.

Method: a text is cut into leaves of at most ``LEAF`` characters, at places
where the tokenizer's own splitting always cuts (before a single blank between
two other characters) if there is one; texts of one leaf are encoded where they
lie. The leaves of longer texts are encoded in parallel as rows of their own and
concatenated pairwise: each level of the tree is one shuffle by (text, pair), so
the halves of one long text are joined by as many tasks as there are pairs. A
join at an always-cut place needs nothing; at any other join ("unsplit text") a
window around it is encoded anew and grown until its first tokens agree with the
left side's and its last ones with the right side's. Adjacent tokens decide a BPE
encoding; where the outermost tokens of the window are those of the side, the
pair at each seam is one that stands in that side's own encoding, so the whole
is the encoding of the whole. ``AGREE`` tokens are asked for rather than one, so
that the splits of the tokenizer have fallen into step as well (tested against
the whole encoding of texts without any safe place).

Every row is followed by a number of its own, so rows with equal or null keys
stay apart.

Defined results: null and empty texts give an empty list; blank texts are
encoded as they are; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.runtime import materialize, table

NAME = "byte_bpe_50k"
LEAF = 8192
#: tokens on which a window and the side it is set in must agree
AGREE = 8
#: the pattern by which byte-level BPE tokenizers of this family split a text first
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_safe = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path(name: str = NAME, folder: str | None = None) -> str:
    """File of a tokenizer's ranks; ``folder`` or LOOMGRAPH_TOKENIZERS overrides the installed place."""
    folder = folder or os.environ.get("LOOMGRAPH_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = str(Path(spec.origin).parent) if spec and spec.origin else "/opt/tokenizers"
    return f"{folder}/{name}.tiktoken"


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of a ranks file, loaded once a worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def leaves(text: str, size: int = LEAF) -> list[tuple[str, bool]]:
    """Leaves of ``text`` and, for each, whether the cut before it is one the tokenizer always makes."""
    out, at, safe, n = [], 0, True, len(text)
    while n - at > size:
        cut = None
        for m in _safe.finditer(text, at + size // 2, at + size + 1):
            cut = m.start()
        nxt = cut if cut is not None else at + size
        out.append((text[at:nxt], safe))
        at, safe = nxt, cut is not None
    out.append((text[at:], safe))
    return out


def _bytes(enc, ids: list[int]) -> bytes:
    return enc.decode_bytes(ids)


def concatenate(enc, left: list[int], right: list[int], safe: bool) -> list[int]:
    """Encoding of two adjoining texts from their encodings."""
    if safe or not left or not right:
        return left + right
    width = 32
    while True:
        i, j = max(0, len(left) - width), min(len(right), width)
        # the window must hold whole characters on both sides
        while i > 0 and _starts_inside(enc, left[i]):
            i -= 1
        while j < len(right) and _starts_inside(enc, right[j]):
            j += 1
        window = enc.encode_ordinary(_bytes(enc, left[i:] + right[:j]).decode("utf-8"))
        a = 0 if i == 0 else _agree(enc, window, left[i:])
        b = 0 if j == len(right) else _agree(enc, window[::-1], right[:j][::-1])
        if a is not None and b is not None and (i == 0 or a) and (j == len(right) or b):
            return left[:i] + window + right[j:]
        if i == 0 and j == len(right):
            return window
        width *= 2


def _starts_inside(enc, token: int) -> bool:
    head = enc.decode_single_token_bytes(token)[:1]
    return bool(head) and 0x80 <= head[0] < 0xC0


def _agree(enc, new: list[int], old: list[int]) -> int | None:
    """Number of tokens at the outer edge on which both agree, if they are enough."""
    same = 0
    for x, y in zip(new, old, strict=False):
        if x != y:
            break
        same += 1
    return same if same >= AGREE else None


def encode_text(enc, text: str | None, size: int = LEAF) -> list[int]:
    """Ids of one text, by way of its leaves."""
    if not text:
        return []
    parts = leaves(text, size)
    if len(parts) == 1:
        return enc.encode_ordinary(text)
    return tree(enc, [(enc.encode_ordinary(t), safe) for t, safe in parts])


def tree(enc, nodes: list[tuple[list[int], bool]]) -> list[int]:
    """Concatenate encoded leaves pairwise, level by level."""
    while len(nodes) > 1:
        nodes = [
            (concatenate(enc, nodes[k][0], nodes[k + 1][0], nodes[k + 1][1]), nodes[k][1]) if k + 1 < len(nodes) else nodes[k]
            for k in range(0, len(nodes), 2)
        ]
    return nodes[0][0] if nodes else []


def _encode_short(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "ids": [enc.encode_ordinary(t) if t else [] for t in pdf["text"]]})

    return run


def _to_leaves(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, key, text in zip(pdf["row"], pdf["key"], pdf["text"], strict=True):
                parts = leaves(text)
                yield pd.DataFrame({"row": row, "key": key, "node": range(len(parts)), "nodes": len(parts), "safe": [s for _, s in parts], "text": [t for t, _ in parts]})

    return run


def _encode_leaves(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            yield pdf.drop(columns="text").assign(ids=[enc.encode_ordinary(t) for t in pdf["text"]])

    return run


def _join_pairs(path: str):
    """Joins neighbouring nodes 2k and 2k + 1 of each text; rows come in the order of (row, node)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        left = None
        for pdf in batches:
            out = []
            for row, key, node, nodes, safe, ids in zip(*(pdf[c] for c in _NODE), strict=True):
                here = (row, key, node // 2, (nodes + 1) // 2, safe, [int(i) for i in ids])
                if node % 2 == 0 and node + 1 < nodes:
                    left = here
                elif node % 2 == 0:
                    out.append(here)
                else:
                    out.append((*left[:5], concatenate(enc, left[5], here[5], safe)))
            yield pd.DataFrame(out, columns=_NODE)

    return run


_NODE = ["row", "key", "node", "nodes", "safe", "ids"]
_NODES = "row bigint, key bigint, node bigint, nodes bigint, safe boolean, ids array<int>"


def encode(df: DataFrame, key: str, column: str = "text", path: str | None = None) -> DataFrame:
    """``key, ids`` of every row. Only texts above one leaf are shuffled, as leaves and as nodes of the tree."""
    path = path or vocabulary_path()
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(column).alias("text"))
    short = rows.where(f"text is null or length(text) <= {LEAF}").mapInPandas(_encode_short(path), "key bigint, ids array<int>")
    long = rows.where(f"length(text) > {LEAF}").withColumn("row", F.monotonically_increasing_id())
    pieces = materialize(long.mapInPandas(_to_leaves(path), "row bigint, key bigint, node bigint, nodes bigint, safe boolean, text string"))  # fixes the row numbers
    nodes = pieces.repartition("row", "node").mapInPandas(_encode_leaves(path), _NODES)
    for _ in range(int(pieces.agg(F.coalesce(F.max("nodes"), F.lit(1))).first()[0] - 1).bit_length()):
        paired = nodes.withColumn("pair", F.expr("node div 2"))
        nodes = paired.repartition("row", "pair").sortWithinPartitions("row", "node").drop("pair").mapInPandas(_join_pairs(path), _NODES)
    return short.unionByName(nodes.select("key", "ids")).withColumnRenamed("key", key)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id")


QUERIES = {"p7_ids": p7_ids}
