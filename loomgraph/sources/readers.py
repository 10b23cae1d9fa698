"""Sources: article CSV, triples as JSON or CSV, CoNLL sequences, label maps."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = "id bigint, title string, content string, text string"
_TRIPLE = ("subject", "subject_type", "relation", "object", "object_type", "obj", "obj_type", "confidence", "frequency", "weight", "source_id", "source_text")


def articles_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Articles with a header, quoted line breaks and possibly a byte-order mark; columns are taken by name."""
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).limit(0).columns
    known = {f.name: f for f in spark.createDataFrame([], schema or ARTICLE).schema.fields}
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(*[F.col(n).try_cast(known[n].dataType).alias(n) if n in known else F.col(n) for n in names])


def triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples from .json (a list, or an object with ``triples``) or .csv (all values text); other suffixes raise ValueError."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".json":
        rows = spark.read.option("multiLine", True).json(path)
        if "triples" in rows.columns:
            rows = rows.select(F.inline("triples"))
        elif "subject" not in rows.columns:
            raise ValueError("JSON input must be a list of triples or an object with 'triples'")
    elif suffix == ".csv":
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unsupported input format: {suffix}")
    have = [c for c in _TRIPLE if c in rows.columns]
    return rows.select(*[F.col(c).cast("string").alias(c) for c in have]).withColumn("triple_id", F.monotonically_increasing_id())


def json_triple_lines(lines: DataFrame, key: str = "triple_id", column: str = "line") -> DataFrame:
    """Triples of raw JSON lines: keys in any order, ``object``/``object_type`` as other names; unreadable lines give none."""
    schema = ", ".join(f"{n} string" for n in _TRIPLE) + ", _bad string"
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    good = lines.select(F.col(key), parsed.alias("r")).where("r is not null and r._bad is null")
    return good.select(
        key, "r.subject", "r.subject_type", "r.relation", F.coalesce("r.obj", "r.object").alias("obj"), F.coalesce("r.obj_type", "r.object_type").alias("obj_type"),
        F.col("r.confidence").try_cast("double").alias("confidence"), F.col("r.source_id").try_cast("bigint").alias("source_id"), "r.source_text",
    )


def conll(spark: SparkSession, path: str) -> DataFrame:
    """``seq_id, tokens, labels`` of token lines in sequences ended by blank lines.

    Fields are split at tabs if a line has one, else at white space; the first
    is the token, the last the label; lines of fewer than two fields are left out.
    """
    # lines end with LF or CRLF; a line of blanks only also ends a sequence. Where no two plain line feeds stand
    # together, as in CRLF files, the separator read by is CRLF twice: one look at the head of the file tells.
    head = spark.read.text(path).limit(1000).agg(F.max(F.col("value").endswith("\r"))).first()[0]
    blocks = spark.read.option("lineSep", "\r\n\r\n" if head else "\n\n").text(path).select(F.monotonically_increasing_id().alias("block_id"), F.regexp_replace("value", "\r", "").alias("value"))
    parts = blocks.select("block_id", F.posexplode(F.split("value", "\n[ \t]*\n")).alias("no", "block"))
    lines = F.filter(F.split("block", "\n"), lambda x: F.length(F.trim(x)) > 0)
    fields = F.transform(lines, lambda x: F.when(x.contains("\t"), F.split(F.trim(x), "\t")).otherwise(F.split(F.trim(x), r"\s+")))
    good = F.filter(fields, lambda f: F.size(f) >= 2)
    seqs = parts.select("block_id", "no", good.alias("f")).where(F.size("f") > 0)
    return seqs.select(
        F.concat_ws(".", "block_id", "no").alias("seq_id"), F.transform("f", lambda x: F.element_at(x, 1)).alias("tokens"), F.transform("f", lambda x: F.element_at(x, -1)).alias("labels")
    )


def label_map(spark: SparkSession, path: str, by_id: bool = False) -> dict:
    """A label map of a model folder; keys are made integers again if they are ids."""
    text = spark.read.option("wholetext", True).text(path).first()[0]
    row = spark.sql("select from_json(:t, 'map<string,string>') as m", args={"t": text}).first()
    return {int(k): v for k, v in row.m.items()} if by_id else {k: int(v) for k, v in row.m.items()}
