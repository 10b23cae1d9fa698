"""Command line: node metrics and summary of a file of triples."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import graph, reporting, triples
from loomgraph.plans.runtime import build_session, materialize
from loomgraph.sources import readers, writers


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="loomgraph", description="Centrality measures of the graph of a triples file.")
    parser.add_argument("--input", default="data/triples.csv", help="triples as .json or .csv")
    parser.add_argument("--output-dir", default="data/graph_metrics", help="folder for node_metrics.csv and summary.json")
    parser.add_argument("--top-k", type=int, default=20, help="nodes in each list of the summary")
    return parser.parse_args(argv)


def run(argv: Sequence[str] | None = None, spark=None) -> DataFrame:
    """Writes both files and returns the lines of the report (``no, line``)."""
    args = arguments(argv)
    spark = spark or build_session("loomgraph")
    rows = materialize(triples.clean(readers.triples(spark, args.input)))
    edges = materialize(rows.groupBy(F.col("subject").alias("src"), F.col("object").alias("dst")).agg(F.sum("weight").alias("weight")))
    measured = materialize(graph.node_metrics(edges, triples.node_types(rows, upgrade=False)))
    totals = graph.summary(edges, graph.measures(edges), rows.agg(F.count_distinct("relation")).first()[0])
    writers.node_metrics(measured, f"{args.output_dir}/node_metrics.csv")
    writers.summary(graph.summary_document(totals, measured, args.top_k), f"{args.output_dir}/summary.json")
    return reporting.console_report(measured, totals, args.input, args.output_dir, args.top_k)


if __name__ == "__main__":
    for r in run().orderBy("no").collect():
        print(r.line)
