"""Property-graph analytics over an edge DataFrame ``src, dst, weight``.

Graphs of at most ``LOCAL_EDGES`` edges (checked by a count) are analysed by
array code over integer nodes in the executors: components and PageRank in one
task, betweenness spread over tasks by source. Names stay in tables; only
numbers are gathered and sent. Beyond the bound the same measures run as
iterative joins whose state is kept in the shared checkpoint folder, so they
survive the loss of executors; betweenness takes its sources in blocks. All ways
give the same values; tests compare them. Exact betweenness is work of nodes
times edges whatever the way; ``sampled_betweenness`` estimates it from a number
of sources.

Empty graphs give empty results; isolated nodes cannot occur, nodes come from edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.paths import PathGraph
from loomgraph.plans.runtime import materialize

#: edges, of two identifiers and a weight, that the driver gathers and every worker holds
LOCAL_EDGES = 8_000_000
#: pairs of nodes up to which betweenness by joins keeps them in one state, if the graph is within LOCAL_EDGES
JOIN_PAIRS = 20_000_000
#: rows (source, node) that one block of sources may need
STATE_ROWS = 1_000_000_000
ALPHA, TOLERANCE, MAX_ROUNDS = 0.85, 1e-6, 100


def node_list(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """In, out and total degree of every node; parallel edges are counted as the rows they are."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        ).alias("e")
    ).select("e.*")
    return ends.groupBy("node").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count(F.lit(1)).alias("degree")
    )


def density(nodes: int, edges: int) -> float:
    return edges / (nodes * (nodes - 1)) if nodes > 1 else 0.0


# ---- array code for bounded graphs -------------------------------------------------------------


class Csr:
    """Adjacency of a bounded graph with integer nodes."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
        self.n = n
        order = np.argsort(src, kind="stable")
        self.src, self.dst, self.weight = src[order], dst[order], weight[order]
        self.start = np.searchsorted(self.src, np.arange(self.n + 1))


def _weak_labels(g: Csr) -> np.ndarray:
    label = np.arange(g.n)
    while True:
        low = label.copy()
        np.minimum.at(low, g.src, label[g.dst])
        np.minimum.at(low, g.dst, label[g.src])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _strong_labels(g: Csr) -> np.ndarray:
    """Smallest node of each strong component, by an iterative depth-first search."""
    index = np.full(g.n, -1)
    low = np.zeros(g.n, np.int64)
    label = np.full(g.n, -1)
    stack: list[int] = []
    count = 0
    for root in range(g.n):
        if index[root] >= 0:
            continue
        work = [(root, g.start[root])]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        while work:
            v, e = work[-1]
            if e < g.start[v + 1]:
                work[-1] = (v, e + 1)
                w = int(g.dst[e])
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    work.append((w, g.start[w]))
                elif label[w] < 0:
                    low[v] = min(low[v], index[w])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
            if low[v] == index[v]:
                group = []
                while True:
                    w = stack.pop()
                    label[w] = g.n
                    group.append(w)
                    if w == v:
                        break
                label[group] = min(group)
    return label


def _ranks(g: Csr, alpha: float = ALPHA, tol: float = TOLERANCE, rounds: int = MAX_ROUNDS) -> np.ndarray:
    out = np.bincount(g.src, g.weight, g.n)
    share = g.weight / np.where(out[g.src] == 0, 1, out[g.src])
    dangling = out == 0
    x = np.full(g.n, 1 / g.n)
    for _ in range(rounds):
        new = alpha * (np.bincount(g.dst, x[g.src] * share, g.n) + x[dangling].sum() / g.n) + (1 - alpha) / g.n
        if np.abs(new - x).sum() < g.n * tol:
            return new
        x = new
    raise ArithmeticError(f"PageRank did not converge in {rounds} rounds")


@dataclass
class Encoded:
    """A bounded graph: ``nodes`` (node, id), identifiers in the order of names; the driver's arrays hold positions in ``ids``."""

    nodes: DataFrame
    ids: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    weight: np.ndarray


def encode(edges: DataFrame) -> Encoded:
    nodes = materialize(node_list(edges).orderBy("node").select("node", F.monotonically_increasing_id().alias("id")))
    end = lambda name: nodes.select(F.col("node").alias(name), F.col("id").alias(f"{name}_id"))
    rows = edges.join(end("src"), "src").join(end("dst"), "dst").select("src_id", "dst_id", F.col("weight").cast("double").alias("weight")).toArrow()
    ends = [rows[c].to_numpy() for c in ("src_id", "dst_id")]
    ids = np.unique(np.concatenate([np.unique(x) for x in ends]))
    return Encoded(nodes, ids, *(np.searchsorted(ids, x).astype(np.int32) for x in ends), rows["weight"].to_numpy())


def hashed(links: DataFrame) -> Encoded | None:
    """The graph of ``src, dst, weight`` by hashes of names, parallel edges summed to one: only numbers are grouped, no name is joined. None beyond the bound, or if two names share a hash."""
    nodes = node_list(links)
    pairs = materialize(links.groupBy(F.xxhash64("src").alias("src_id"), F.xxhash64("dst").alias("dst_id")).agg(F.sum(F.col("weight").cast("double")).alias("weight")))
    if not is_local(pairs):
        return None
    rows = pairs.toArrow()
    ends = [rows[c].to_numpy() for c in ("src_id", "dst_id")]
    ids = np.unique(np.concatenate([np.unique(x) for x in ends]))
    if len(ids) != nodes.count():
        return None
    return Encoded(nodes.select("node", F.xxhash64("node").alias("id")), ids, *(np.searchsorted(ids, x).astype(np.int32) for x in ends), rows["weight"].to_numpy())


def measure_ids(g: Encoded) -> DataFrame:
    """``id, wcc, scc, pagerank, in_degree, out_degree``, components by the identifier of their smallest node, computed in one task."""
    spark = g.nodes.sparkSession
    shared = spark.sparkContext.broadcast((g.ids, g.src, g.dst, g.weight))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, src, dst, weight = shared.value
        if sum(map(len, batches)) and len(ids):
            csr = Csr(len(ids), src, dst, weight)
            yield pd.DataFrame({"id": ids, "wcc": ids[_weak_labels(csr)], "scc": ids[_strong_labels(csr)], "pagerank": _ranks(csr), "in_degree": np.bincount(dst, minlength=len(ids)), "out_degree": np.bincount(src, minlength=len(ids))})

    return spark.range(0, 1, 1, 1).mapInPandas(run, "id bigint, wcc bigint, scc bigint, pagerank double, in_degree bigint, out_degree bigint")


def local_measures(edges: DataFrame) -> DataFrame:
    """``node, wcc, scc, pagerank`` of a bounded graph."""
    g = encode(edges)
    name = lambda c: g.nodes.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    found = measure_ids(g).withColumnsRenamed({"wcc": "wcc_id", "scc": "scc_id"})
    return found.join(g.nodes, "id").join(name("wcc"), "wcc_id").join(name("scc"), "scc_id").select("node", "wcc", "scc", "pagerank")


def betweenness_ids(g: Encoded) -> DataFrame:
    """``id, betweenness`` of the nodes inside paths; the reduced adjacency goes to every task, searches are spread."""
    spark, n = g.nodes.sparkSession, len(g.ids)
    paths = PathGraph(g.src, g.dst, n)
    runs, scale = len(paths.runs), 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    tasks = max(1, min(runs // 32, max(4 * spark.sparkContext.defaultParallelism, runs // 1000)))
    shared = spark.sparkContext.broadcast((paths, g.ids))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths, ids = shared.value
        for k in (k for pdf in batches for k in pdf["id"]):
            total = paths.dependencies(paths.runs[k::tasks])
            hit = np.flatnonzero(total)
            yield pd.DataFrame({"id": ids[paths.inner[hit]], "part": total[hit]})

    return spark.range(0, tasks, 1, tasks).mapInPandas(run, "id bigint, part double").groupBy("id").agg((F.greatest(F.sum("part"), F.lit(0.0)) * scale).alias("betweenness"))  # what is taken off may leave a trace below 0


def local_betweenness(edges: DataFrame) -> DataFrame:
    """``node, betweenness`` of a bounded graph."""
    g = encode(edges)
    return g.nodes.join(betweenness_ids(g), "id", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


# ---- iterative joins for graphs of any size ----------------------------------------------------


def weak_components(edges: DataFrame) -> DataFrame:
    """``node, wcc``: smallest node of the weak component, by label propagation with pointer jumping."""
    both = materialize(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        far = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        nxt = materialize(low.join(far, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("new"), "label"))
        if nxt.where("new <> label").isEmpty():
            return nxt.select("node", F.col("new").alias("wcc"))
        labels = nxt.select("node", F.col("new").alias("label"))


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, scc``: trimming of nodes without in- or out-edges, then forward-backward colouring."""
    left = materialize(edges.select("src", "dst").where("src <> dst").distinct())
    done = node_list(edges).limit(0).select("node", F.col("node").alias("scc"))
    rest = materialize(node_list(edges))
    while not rest.isEmpty():
        while True:  # trim
            inner = left.select(F.col("dst").alias("node")).distinct().join(left.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
            core = materialize(rest.join(inner, "node", "left_semi"))
            trimmed = rest.join(core, "node", "left_anti").select("node", F.col("node").alias("scc"))
            done = materialize(done.unionByName(trimmed))
            if core.count() == rest.count():
                break
            rest = core
            left = materialize(left.join(rest.withColumnRenamed("node", "src"), "src", "left_semi").join(rest.withColumnRenamed("node", "dst"), "dst", "left_semi"))
        if rest.isEmpty():
            break
        colour = materialize(rest.select("node", F.col("node").alias("c")))
        while True:  # the smallest node that reaches each node
            pushed = left.join(colour.select(F.col("node").alias("src"), F.col("c").alias("pc")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("pc").alias("pc"))
            nxt = materialize(colour.join(pushed, "node", "left").select("node", "c", F.least("c", F.coalesce("pc", "c")).alias("n")))
            if nxt.where("n <> c").isEmpty():
                break
            colour = nxt.select("node", F.col("n").alias("c"))
        found = materialize(colour.where("node = c"))
        inside = materialize(
            left.join(colour.withColumnsRenamed({"node": "src", "c": "cs"}), "src").join(colour.withColumnsRenamed({"node": "dst", "c": "cd"}), "dst").where("cs = cd").select("src", "dst", "cs")
        )
        while True:  # backwards within each colour
            back = inside.join(found.select(F.col("node").alias("dst"), "c"), "dst").where("c = cs").select(F.col("src").alias("node"), "c").distinct()
            more = materialize(found.unionByName(back).distinct())
            if more.count() == found.count():
                break
            found = more
        done = materialize(done.unionByName(found.select("node", F.col("c").alias("scc"))))
        rest = materialize(rest.join(found, "node", "left_anti"))
        left = materialize(left.join(rest.withColumnRenamed("node", "src"), "src", "left_semi").join(rest.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return done


def pagerank(edges: DataFrame, alpha: float = ALPHA, tol: float = TOLERANCE, rounds: int = MAX_ROUNDS) -> DataFrame:
    """``node, pagerank``: power iteration from the uniform vector, dangling mass spread uniformly."""
    nodes = materialize(node_list(edges))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("pagerank"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("w_out"))
    links = materialize(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("w_out")).alias("share")))
    ranks = nodes.join(out.select(F.col("src").alias("node"), F.lit(False).alias("dangling")), "node", "left").select(
        "node", F.lit(1.0 / n).alias("x"), F.coalesce("dangling", F.lit(True)).alias("dangling")
    )
    ranks = materialize(ranks)
    for _ in range(rounds):
        lost = ranks.where("dangling").agg(F.coalesce(F.sum("x"), F.lit(0.0))).first()[0]
        got = links.join(ranks.select(F.col("node").alias("src"), "x"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("x") * F.col("share")).alias("g"))
        fresh = alpha * (F.coalesce("g", F.lit(0.0)) + lost / n) + (1 - alpha) / n
        nxt = materialize(ranks.join(got, "node", "left").select("node", fresh.alias("x"), "dangling", F.abs(fresh - F.col("x")).alias("moved")))
        moved = nxt.agg(F.sum("moved")).first()[0]
        ranks = nxt.drop("moved")
        if moved < n * tol:
            return ranks.select("node", F.col("x").alias("pagerank"))
    raise ArithmeticError(f"PageRank did not converge in {rounds} rounds")


def _dependency_sums(links: DataFrame, sources: DataFrame) -> DataFrame:
    """``v, delta``: dependencies on every node summed over ``sources``, level by level, keyed by (source, node)."""
    seen = materialize(sources.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("sigma")))
    front, depth = seen, 0
    while True:
        step = front.join(links, front.v == links.src).select("s", F.col("dst").alias("v"), "sigma")
        new = step.join(seen.select("s", "v"), ["s", "v"], "left_anti").groupBy("s", "v").agg(F.sum("sigma").alias("sigma"))
        front = materialize(new.select("s", "v", F.lit(depth + 1).alias("d"), "sigma"))
        if front.isEmpty():
            break
        depth += 1
        seen = materialize(seen.unionByName(front))
    delta = seen.where(F.col("d") == depth).select("s", "v", F.lit(0.0).alias("delta"))
    total = delta.limit(0).select("v", "delta")
    for d in range(depth - 1, -1, -1):
        below = seen.where(F.col("d") == d + 1).join(delta, ["s", "v"], "left").select("s", F.col("v").alias("w"), F.col("sigma").alias("sw"), F.coalesce("delta", F.lit(0.0)).alias("dw"))
        here = seen.where(F.col("d") == d).select("s", "v", F.col("sigma").alias("sv"))
        part = here.join(links, here.v == links.src).join(below.withColumnRenamed("w", "dst"), ["s", "dst"])
        delta = materialize(part.groupBy("s", "v").agg(F.sum(F.col("sv") / F.col("sw") * (1 + F.col("dw"))).alias("delta")))
        if d > 0:
            total = total.unionByName(delta.select("v", "delta"))
    return total.groupBy("v").agg(F.sum("delta").alias("delta"))


def betweenness(edges: DataFrame, state_rows: int | None = None, sample: int | None = None, seed: int = 42) -> DataFrame:
    """``node, betweenness``: Brandes' algorithm as joins over blocks of sources, or over ``sample`` sources chosen by a hash of the node.

    A state of pairs beyond ``JOIN_PAIRS`` is not built where array code can do the work without one: the result is the same.
    """
    links = materialize(edges.select("src", "dst").distinct())
    nodes = materialize(node_list(edges))
    n = nodes.count()
    if sample is None and state_rows is None and n * n > JOIN_PAIRS and is_local(links):
        return local_betweenness(links.withColumn("weight", F.lit(1.0)))
    place = F.xxhash64(F.lit(seed), "node")
    sources = materialize((nodes if sample is None else nodes.orderBy(place, "node").limit(sample)).select("node", place.alias("h")))
    m = sources.count()
    blocks = max(1, -(-m * n // (state_rows or STATE_ROWS)))
    parts = [materialize(_dependency_sums(links, sources.where(F.pmod("h", F.lit(blocks)) == b))) for b in range(blocks)]
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    scale = (1 / ((n - 1) * (n - 2)) if n > 2 else 1.0) * (n / m if m else 1.0)
    sums = total.groupBy(F.col("v").alias("node")).agg((F.sum("delta") * scale).alias("betweenness"))
    return nodes.join(sums, "node", "left").fillna(0.0, ["betweenness"])


def sampled_betweenness(edges: DataFrame, sources: int, seed: int = 42) -> DataFrame:
    """Estimate of betweenness from the shortest paths of ``sources`` nodes; unbiased, with an error that falls as their root."""
    return betweenness(edges, sample=sources, seed=seed)


# ---- assembled results -------------------------------------------------------------------------


def is_local(edges: DataFrame) -> bool:
    return edges.count() <= LOCAL_EDGES


def measures(edges: DataFrame) -> DataFrame:
    """``node, wcc, scc, pagerank`` by whichever way the size of the graph allows."""
    if is_local(edges):
        return local_measures(edges)
    return weak_components(edges).join(strong_components(edges), "node").join(pagerank(edges), "node")


def any_betweenness(edges: DataFrame) -> DataFrame:
    return local_betweenness(edges) if is_local(edges) else betweenness(edges)


def node_metrics(edges: DataFrame, types: DataFrame) -> DataFrame:
    """The node metric rows: ``node, entity_type, in_degree, out_degree, degree, betweenness, pagerank, ord``."""
    if is_local(edges):
        g = encode(edges)
        central = g.nodes.join(measure_ids(g).select("id", "pagerank"), "id").join(betweenness_ids(g), "id", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), "pagerank")
    else:
        central = betweenness(edges).join(measures(edges).select("node", "pagerank"), "node")
    return (
        types.select("node", "entity_type", "ord").join(degrees(edges), "node").join(central, "node")
        .select("node", "entity_type", "in_degree", "out_degree", "degree", "betweenness", "pagerank", "ord")
    )


def number_metrics(g: Encoded) -> DataFrame:
    """The numbers of ``node_metrics`` and the components, ``id`` for the node; edges are counted as the pairs they are."""
    return measure_ids(g).join(betweenness_ids(g), "id", "left").withColumns({"betweenness": F.coalesce("betweenness", F.lit(0.0)), "degree": F.col("in_degree") + F.col("out_degree")})


def leaders(numbers: DataFrame, keys: list[str], k: int = 20) -> DataFrame:
    """The rows that can be among the ``k`` first by one of ``keys``: all that are not below the k-th in their numbers, so that names settle the ties."""
    chosen = F.lit(False)
    for key in keys:
        row = F.struct(*dict.fromkeys((key, "degree", "betweenness", "pagerank")))
        least = numbers.select(row.alias("row")).orderBy(F.desc("row")).limit(k).agg(F.min("row")).first()[0]
        if least is not None:
            chosen |= row >= F.struct(*(F.lit(v).alias(c) for c, v in least.asDict().items()))
    return numbers.where(chosen)


def base_order() -> list:
    """All descending: degree, betweenness, PageRank, name in lower case; then first appearance."""
    return [F.desc("degree"), F.desc("betweenness"), F.desc("pagerank"), F.desc(F.lower("node")), F.asc("ord")]


def top(metrics: DataFrame, key: str, k: int = 20) -> DataFrame:
    """The ``k`` first nodes by ``key`` and degree, ties in base order, with their rank."""
    best = metrics.orderBy(F.desc(key), F.desc("degree"), *base_order()).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc(key), F.desc("degree"), *base_order()))  # over k rows
    return best.withColumn("rank", rank)


def summary(edges: DataFrame | int, parts: DataFrame, relation_types: int) -> DataFrame:
    """One row, of the edges or their number: nodes, edges, density, strong and weak components, relation types, size of the largest weak component."""
    sizes = parts.groupBy("wcc").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest_wcc"))
    m = edges if isinstance(edges, int) else edges.count()
    counted = parts.agg(
        F.count(F.lit(1)).alias("nodes"), F.count_distinct("scc").alias("strongly_connected_components"), F.count_distinct("wcc").alias("weakly_connected_components")
    ).crossJoin(sizes)  # two single rows
    n = F.col("nodes")
    return counted.select(
        "nodes", F.lit(m).cast("bigint").alias("edges_unique"),
        F.when(n > 1, F.lit(float(m)) / (n * (n - 1))).otherwise(0.0).alias("density"),
        "strongly_connected_components", "weakly_connected_components", F.lit(relation_types).cast("bigint").alias("relation_types"), "largest_wcc",
    )


def summary_document(graph_row: DataFrame, metrics: DataFrame, k: int = 20) -> DataFrame:
    """The summary as one JSON document: graph totals and three top lists."""
    cols = ["node", "entity_type", "in_degree", "out_degree", "degree", "betweenness", "pagerank"]
    lists = None
    for name, key in (("top_by_degree", "degree"), ("top_by_betweenness", "betweenness"), ("top_by_pagerank", "pagerank")):
        one = top(metrics, key, k).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct(*cols).alias("row")))), lambda r: r["row"]).alias(name))
        lists = one if lists is None else lists.crossJoin(one)  # single rows of k nodes
    graph_cols = ["nodes", "edges_unique", "density", "strongly_connected_components", "weakly_connected_components", "relation_types"]
    return graph_row.select(F.struct(*graph_cols).alias("graph")).crossJoin(lists).select(
        F.to_json(F.struct("graph", "top_by_degree", "top_by_betweenness", "top_by_pagerank")).alias("document")
    )


def top_subgraph(edges: DataFrame, ordered_nodes: DataFrame, k: int = 30) -> DataFrame:
    """Edges whose two ends are among the ``k`` nodes of highest total degree (ties by first appearance)."""
    chosen = ordered_nodes.orderBy(F.desc("degree"), "ord").limit(k).select("node")
    return edges.join(F.broadcast(chosen.withColumnRenamed("node", "src")), "src", "left_semi").join(
        F.broadcast(chosen.withColumnRenamed("node", "dst")), "dst", "left_semi"
    )


def first_parallel(multi: DataFrame) -> DataFrame:
    """The first of the parallel edges of each pair, to stand for all of them."""
    return multi.groupBy("src", "dst").agg(F.min(F.struct("ord", "relation", "confidence", "frequency", "weight")).alias("e")).select("src", "dst", "e.*")


def merge_incremental(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after adding triples: unknown nodes are inserted, types never upgraded, each triple is one more edge."""
    ends = new.select(
        F.explode(
            F.array(
                F.struct(F.col("subject").alias("node"), F.col("subject_type").alias("entity_type"), (F.col("ord") * 2).alias("o")),
                F.struct(F.col("obj").alias("node"), F.col("obj_type").alias("entity_type"), (F.col("ord") * 2 + 1).alias("o")),
            )
        ).alias("e")
    ).select("e.*")
    fresh = ends.groupBy("node").agg(F.min(F.struct("o", "entity_type"))["entity_type"].alias("entity_type")).join(nodes, "node", "left_anti")
    added = new.select(
        F.col("subject").alias("src"), F.col("obj").alias("dst"), "relation", "confidence", F.lit(1).cast("bigint").alias("frequency"), F.col("confidence").alias("weight"), "source_id"
    )
    return nodes.select("node", "entity_type").unionByName(fresh), edges.unionByName(added)
