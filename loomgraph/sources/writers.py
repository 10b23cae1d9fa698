"""Sinks: CoNLL, JSON records, triples as CSV and as one document, graph XML, metrics and summary."""

from __future__ import annotations

import json as _json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import PurePosixPath
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BOM = "\ufeff"


@contextmanager
def shared_text(spark, path: str, block: int = 1 << 20) -> Iterator[Callable[[str], None]]:
    """Writes one text file to any file system Spark knows, block by block; the file is there whole or not at all."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target, part = hadoop(path), hadoop(f"{path}._part")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, held = system.create(part, True), bytearray()

    def put(text: str) -> None:
        held.extend(text.encode("utf-8"))
        if len(held) >= block:
            out.write(held)
            held.clear()

    try:
        yield put
        out.write(held)
        out.close()
    except BaseException:
        out.close()
        system.delete(part, False)
        raise
    system.delete(target, True)
    if not system.rename(part, target):
        raise OSError(f"could not write {path}")


def conll(df: DataFrame, labelled: str, path: str, mode: str = "overwrite", order: str | None = None) -> int:
    """Sequences as ``token<TAB>label`` lines, a blank line after each; empty ones are skipped. Returns their number."""
    some = df.where(F.size(labelled) > 0)
    text = some.select(*([order] if order else []), F.concat(F.concat_ws("\n", F.transform(labelled, lambda x: F.concat_ws("\t", x["token"], x["label"]))), F.lit("\n")).alias("value"))
    (text.orderBy(order) if order else text).select("value").write.mode(mode).text(path)
    return some.count()


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def json_array(df: DataFrame, path: str) -> None:
    """The records as one indented JSON array in one file, streamed partition by partition; ``json_lines`` is the form for many files."""
    with shared_text(df.sparkSession, path) as put:
        put("[")
        for i, row in enumerate(df.toLocalIterator(prefetchPartitions=True)):
            put((",\n" if i else "\n") + _json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2, default=str))
        put("\n]\n")


def csv(df: DataFrame, path: str, mode: str = "overwrite", bom: bool = False) -> None:
    """CSV files with a header in each; ``bom``: each begins with a byte-order mark."""
    df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0]) if bom else df
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


METRIC_COLUMNS = ("node", "entity_type", "in_degree", "out_degree", "degree", "betweenness", "pagerank")


def node_metrics(metrics: DataFrame, path: str) -> None:
    """Node metrics with a byte-order mark, in their fixed columns and order, as one file (a node is one short row)."""
    from loomgraph.operators.graph import base_order

    csv(metrics.orderBy(*base_order()).select(*METRIC_COLUMNS).coalesce(1), path, bom=True)


def summary(document: DataFrame, path: str) -> None:
    """The one-row summary document as an indented file with a byte-order mark."""
    with shared_text(document.sparkSession, path) as put:
        put(BOM + _json.dumps(_json.loads(document.first()[0]), ensure_ascii=False, indent=2) + "\n")


def model_files(spark, folder: str, labels: DataFrame, config: dict, metrics: dict) -> None:
    """Label maps both ways, settings and test metrics of a model folder; ``labels`` are few (``label, label_id``)."""
    pairs = sorted((r.label_id, r.label) for r in labels.collect())
    files = {"label2id": {name: i for i, name in pairs}, "id2label": {str(i): name for i, name in pairs}, "training_config": config, "test_metrics": metrics}
    for name, value in files.items():
        with shared_text(spark, f"{folder}/{name}.json") as put:
            put(_json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def parquet(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def document(meta: DataFrame, rows: DataFrame, path: str, name: str = "triples") -> None:
    """One JSON document ``{metadata, rows}``, streamed row by row into one file."""
    with shared_text(rows.sparkSession, path) as put:
        put('{"metadata": ' + _json.dumps(meta.first().asDict(recursive=True), ensure_ascii=False) + f', "{name}": [')
        for i, row in enumerate(rows.toLocalIterator(prefetchPartitions=True)):
            put((",\n" if i else "\n") + _json.dumps(row.asDict(recursive=True), ensure_ascii=False))
        put("]}\n")


def _graphml(nodes: DataFrame, edges: DataFrame) -> Iterator[str]:
    keys = (("entity_type", "node", "string"), ("relation", "edge", "string"), ("confidence", "edge", "double"), ("frequency", "edge", "long"), ("weight", "edge", "double"))
    yield '<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
    for name, on, kind in keys:
        yield f'<key id="{name}" for="{on}" attr.name="{name}" attr.type="{kind}"/>\n'
    yield '<graph edgedefault="directed">\n'
    for n in nodes.select("node", "entity_type").toLocalIterator():
        yield f'<node id={quoteattr(n.node)}><data key="entity_type">{escape(str(n.entity_type))}</data></node>\n'
    for e in edges.select("src", "dst", "relation", "confidence", "frequency", "weight").toLocalIterator():
        data = "".join(f'<data key="{k}">{escape(str(e[k]))}</data>' for k in ("relation", "confidence", "frequency", "weight"))
        yield f"<edge source={quoteattr(e.src)} target={quoteattr(e.dst)}>{data}</edge>\n"
    yield "</graph>\n</graphml>\n"


def _gexf(nodes: DataFrame, edges: DataFrame) -> Iterator[str]:
    yield '<?xml version="1.0" encoding="utf-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3">\n<graph defaultedgetype="directed">\n'
    yield '<attributes class="node"><attribute id="0" title="entity_type" type="string"/></attributes>\n'
    yield '<attributes class="edge"><attribute id="0" title="relation" type="string"/></attributes>\n<nodes>\n'
    for n in nodes.select("node", "entity_type").toLocalIterator():
        yield f'<node id={quoteattr(n.node)} label={quoteattr(n.node)}><attvalues><attvalue for="0" value={quoteattr(str(n.entity_type))}/></attvalues></node>\n'
    yield "</nodes>\n<edges>\n"
    for i, e in enumerate(edges.select("src", "dst", "relation", "weight").toLocalIterator()):
        yield f'<edge id="{i}" source={quoteattr(e.src)} target={quoteattr(e.dst)} weight="{e.weight}"><attvalues><attvalue for="0" value={quoteattr(str(e.relation))}/></attvalues></edge>\n'
    yield "</edges>\n</graph>\n</gexf>\n"


def graph_xml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The collapsed graph as .graphml or .gexf; rows are streamed, the graph is never held in memory."""
    parts = {".graphml": _graphml, ".gexf": _gexf}.get(PurePosixPath(path).suffix.lower())
    if parts is None:
        raise ValueError(f"unsupported graph format: {path}")
    with shared_text(nodes.sparkSession, path) as put:
        for part in parts(nodes, edges):
            put(part)


def html(nodes: DataFrame, edges: DataFrame, path: str, limit: int = 200) -> None:
    """An interactive page of styled nodes and edges; it draws at most ``limit`` nodes and says so if there are more."""
    from loomgraph.sources import pages

    pages.save(nodes.sparkSession, pages.interactive_page(pages.network(nodes, edges, limit)), path)


def listing(spark, folder: str) -> DataFrame:
    """Files of an output folder with their sizes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "length").orderBy("path")
