import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph, paths, reporting, triples
from loomgraph.plans import queries

SCHEMA = "triple_id long, subject string, subject_type string, relation string, obj string, obj_type string, weight string, confidence double, frequency string, source_id long"


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        (1, "a", "T", "R1", "b", "T", "1", 0.9, None, 1), (2, " a ", "X", "R2", "b", "T", "2", 0.9, "3.7", 1), (3, "b", "", "R1", "c", None, "1", None, "x", 1),
        (4, "c", "T", "R1", "a", "T", "1", None, None, 1), (5, "d", "T", "R1", "d", "T", "1", None, None, 1), (6, "e", None, " ", "f", " ", "x", 0.5, None, 1),
        (7, None, "T", "R", "a", "T", "1", None, None, 1), (8, "g", "T", "R", "  ", "T", "1", None, None, 1),
    ]
    return triples.clean(spark.createDataFrame(rows, SCHEMA))


def edges_of(clean):
    return clean.groupBy(F.col("subject").alias("src"), F.col("object").alias("dst")).agg(F.sum("weight").alias("weight"))


def test_clean_and_collapse(small):
    got = {(r.subject, r.object): r for r in triples.collapse(small).collect()}
    assert set(got) == {("a", "b"), ("b", "c"), ("c", "a"), ("e", "f")}
    ab = got["a", "b"]
    assert (ab.weight, ab.frequency, ab.triple_count, ab.relations) == (3.0, 4, 2, {"R1": 1, "R2": 1})
    assert got["e", "f"].weight == 0.5 and got["e", "f"].relations == {"LIEN_QUAN": 1}
    types = {r.node: r.entity_type for r in triples.node_types(small, False).collect()}
    assert types["b"] == "T" and types["c"] == "UNKNOWN" and types["e"] == types["f"] == "UNKNOWN"
    assert {r.node: r.entity_type for r in triples.node_types(small, True).collect()}["c"] == "T"


def test_small_measures(small):
    e = edges_of(small)
    m = {r.node: r for r in graph.measures(e).collect()}
    assert len({r.wcc for r in m.values()}) == 2 and len({r.scc for r in m.values()}) == 3
    b = {r.node: r.betweenness for r in graph.local_betweenness(e).collect()}
    assert b == pytest.approx({"a": 1 / 12, "b": 1 / 12, "c": 1 / 12, "e": 0, "f": 0})
    s = graph.summary(e, graph.measures(e), 3).first()
    assert (s.nodes, s.edges_unique, s.density, s.weakly_connected_components, s.strongly_connected_components) == (5, 4, 0.2, 2, 3)


def brute_betweenness(nodes, adj):
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sigma, order, queue = {s: 0}, {s: 1.0}, [], [s]
        pred = {v: [] for v in nodes}
        while queue:
            v = queue.pop(0)
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] = sigma.get(w, 0) + sigma[v]
                    pred[w].append(v)
        delta = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in pred[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


def test_joins_equal_arrays_equal_brute_force(spark):
    rng = random.Random(5)
    names = [f"n{i:02d}" for i in range(22)]
    pairs = sorted({(a, b) for a, b in itertools.product(names, names) if a != b and rng.random() < 0.07})
    e = spark.createDataFrame([(a, b, float(rng.randint(1, 4))) for a, b in pairs], "src string, dst string, weight double").cache()
    local = {r.node: r for r in graph.local_measures(e).collect()}
    assert {r.node: r.wcc for r in graph.weak_components(e).collect()} == {n: r.wcc for n, r in local.items()}
    assert {r.node: r.scc for r in graph.strong_components(e).collect()} == {n: r.scc for n, r in local.items()}
    assert {r.node: r.pagerank for r in graph.pagerank(e).collect()} == pytest.approx({n: r.pagerank for n, r in local.items()})
    assert sum(r.pagerank for r in local.values()) == pytest.approx(1.0)
    nodes = sorted({n for p in pairs for n in p})
    want = brute_betweenness(nodes, {n: [b for a, b in pairs if a == n] for n in nodes})
    assert {r.node: r.betweenness for r in graph.local_betweenness(e).collect()} == pytest.approx(want)
    assert {r.node: r.betweenness for r in graph.betweenness(e).collect()} == pytest.approx(want)
    n = len(want)
    assert {r.node: r.betweenness for r in graph.betweenness(e, state_rows=n * n // 3).collect()} == pytest.approx(want)  # blocks of sources
    assert {r.node: r.betweenness for r in graph.sampled_betweenness(e, n).collect()} == pytest.approx(want)  # all of them


def hub_edges(spark, n):
    """``n`` sources, a hub, ``n`` targets: only the hub is inside paths, of all n * n of them."""
    ends = spark.range(n)
    return ends.select(F.format_string("s%07d", "id").alias("src"), F.lit("hub").alias("dst"), F.lit(1.0).alias("weight")).union(
        ends.select(F.lit("hub"), F.format_string("t%07d", "id"), F.lit(1.0))
    )


def test_betweenness_of_many_nodes_keeps_no_pairs(spark, monkeypatch):
    n = 260_000
    monkeypatch.setattr(graph, "_dependency_sums", None)  # 6.8e10 rows
    best = graph.any_betweenness(hub_edges(spark, n)).where("betweenness > 0").collect()
    assert [(r.node, r.betweenness) for r in best] == [("hub", pytest.approx(n * n / (2 * n * (2 * n - 1))))]


def test_betweenness_by_joins_builds_no_large_state(spark, monkeypatch):
    e = hub_edges(spark, 8)
    want = {r.node: r.betweenness for r in graph.betweenness(e).collect()}
    assert want["hub"] == pytest.approx(64 / (16 * 15))
    monkeypatch.setattr(graph, "_dependency_sums", None)
    monkeypatch.setattr(graph, "JOIN_PAIRS", 17 * 17 - 1, raising=False)
    assert {r.node: r.betweenness for r in graph.betweenness(e).collect()} == pytest.approx(want)


@pytest.fixture(scope="module")
def hub_metrics(spark):
    n = 260_000  # above the half million edges that were the bound of the array code
    edges = hub_edges(spark, n).localCheckpoint()
    types = graph.node_list(edges).select("node", F.lit("T").alias("entity_type"), F.xxhash64("node").alias("ord"))
    with pytest.MonkeyPatch.context() as patch:
        for name in ("_dependency_sums", "weak_components", "strong_components", "pagerank"):
            patch.setattr(graph, name, None)
        return edges, graph.node_metrics(edges, types).localCheckpoint(), graph.measures(edges).localCheckpoint()


def test_node_metrics_without_joins_of_pairs(hub_metrics):
    edges, metrics, _ = hub_metrics
    n = edges.count() // 2
    hub = metrics.where("node = 'hub'").first()
    assert metrics.count() == 2 * n + 1 and (hub.in_degree, hub.out_degree, hub.degree) == (n, n, 2 * n)
    assert hub.betweenness == pytest.approx(n / (2 * (2 * n - 1))) and metrics.agg(F.sum("pagerank")).first()[0] == pytest.approx(1)


def test_summary_document_of_many_nodes(hub_metrics):
    edges, metrics, parts = hub_metrics
    got = json.loads(graph.summary_document(graph.summary(edges, parts, 1), metrics).first().document)
    n = edges.count()
    assert (got["graph"]["nodes"], got["graph"]["edges_unique"], got["graph"]["weakly_connected_components"], got["graph"]["strongly_connected_components"]) == (n + 1, n, 1, n + 1)
    assert all(len(got[f"top_by_{k}"]) == 20 and got[f"top_by_{k}"][0]["node"] == "hub" for k in ("degree", "betweenness", "pagerank"))


def test_console_report_of_many_nodes(hub_metrics):
    edges, metrics, parts = hub_metrics
    lines = [r.line for r in reporting.console_report(metrics, graph.summary(edges, parts, 1), "a", "b").orderBy("no").collect()]
    assert len(lines) == 34 and f"{edges.count() + 1} nodes" in lines[0] and all(" 1. hub |" in lines[k] for k in (2, 13, 24))


def test_top_betweenness_of_many_nodes(hub_metrics):
    best = graph.top(hub_metrics[1], "betweenness").collect()
    assert len(best) == 20 and (best[0].node, best[0].rank) == ("hub", 1)


def test_top_pagerank_of_many_nodes(hub_metrics):
    best = graph.top(hub_metrics[1], "pagerank").collect()
    assert len(best) == 20 and (best[0].node, best[0].rank) == ("hub", 1)


def test_top_degree_of_many_nodes(hub_metrics):
    best = graph.top(hub_metrics[1], "degree").collect()
    assert len(best) == 20 and (best[0].node, best[0].rank) == ("hub", 1)


RING = [f"{'Nn'[k % 2]}{k:02d}" for k in range(30)]


@pytest.fixture(scope="module")
def ring(spark, tmp_path_factory):
    """A ring whose nodes are alike in all numbers, so that names settle every order; an edge comes twice, two types change later."""
    d = str(tmp_path_factory.mktemp("ring"))
    rows = [(29 - k, RING[k], f"T{k % 3}", "R", RING[(k + 1) % 30], "LATER", 0.5, k) for k in range(30)] + [(30, RING[4], "U", "Q", RING[5], "U", 0.5, 1)]
    spark.createDataFrame(rows, "triple_id long, subject string, subject_type string, relation string, obj string, obj_type string, confidence double, source_id long").write.parquet(f"{d}/triples.parquet")
    return d


def without_names(name, spark, d):
    """The rows of a query where no names can be joined, and where all must be."""
    with pytest.MonkeyPatch.context() as patch:
        for x in ("encode", "degrees", "node_metrics"):
            patch.setattr(graph, x, None)
        got = [r.asDict() for r in queries.QUERIES[name](spark, d).collect()]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(graph, "hashed", lambda links: None, raising=False)  # as for two names of one hash
        want = [r.asDict() for r in queries.QUERIES[name](spark, d).collect()]
    return got, want


def test_console_report_joins_no_names(spark, ring):
    got, want = without_names("q_console_report", spark, ring)
    got, want = [[r["line"] for r in sorted(x, key=lambda r: r["no"])] for x in (got, want)]
    assert got == want and len(got) == 34 and "30 nodes, 30 unique" in got[0]
    assert [x.split()[1] for x in got[2:12]] == sorted(RING, key=str.lower, reverse=True)[:10]


def test_summary_document_joins_no_names(spark, ring):
    got, want = without_names("q_summary_document", spark, ring)
    assert got == want and len(got) == 1
    doc = json.loads(got[0]["document"])
    assert doc["graph"] == {"nodes": 30, "edges_unique": 30, "density": pytest.approx(1 / 29), "strongly_connected_components": 1, "weakly_connected_components": 1, "relation_types": 2}
    assert [r["node"] for r in doc["top_by_pagerank"]] == sorted(RING, key=str.lower, reverse=True)[:20]


def test_top_betweenness_joins_no_names(spark, ring):
    got, want = without_names("q_top_betweenness", spark, ring)
    assert got == want and [r["node"] for r in got] == sorted(RING, key=str.lower, reverse=True)[:20] and all(r["entity_type"] == f"T{int(r['node'][1:]) % 3}" for r in got)


def test_top_pagerank_joins_no_names(spark, ring):
    got, want = without_names("q_top_pagerank", spark, ring)
    assert got == want and [r["node"] for r in got] == sorted(RING, key=str.lower, reverse=True)[:20] and all(r["entity_type"] == f"T{int(r['node'][1:]) % 3}" for r in got)


def test_top_degree_joins_no_names(spark, ring):
    got, want = without_names("q_top_degree", spark, ring)
    assert got == want and [r["node"] for r in got] == sorted(RING, key=str.lower, reverse=True)[:20] and all(r["entity_type"] == f"T{int(r['node'][1:]) % 3}" for r in got)


def test_reduced_paths_equal_brute_force():
    rng = random.Random(3)
    for trial in range(150):
        n, few = rng.randint(3, 24), trial % 2 * 3000
        s, t = [[int(rng.triangular(0, n, low)) for _ in range(rng.randint(0, 3 * n))] for low in (0, n)]
        m = min(len(s), len(t))
        g = paths.PathGraph(np.array(s[:m], np.int64), np.array(t[:m], np.int64), n)
        got = np.zeros(n)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(paths, "FEW", few)
            got[g.inner] = g.dependencies(g.runs)
        want = brute_betweenness(range(n), {v: sorted({b for a, b in zip(s, t) if a == v != b}) for v in range(n)})
        assert list(got) == pytest.approx([want[v] * (n - 1) * (n - 2) for v in range(n)])


def test_empty_graph(spark):
    e = spark.createDataFrame([], "src string, dst string, weight double")
    assert graph.degrees(e).count() == 0 and graph.local_measures(e).count() == 0 and graph.weak_components(e).count() == 0 and graph.pagerank(e).count() == 0


def test_dedup_keeps_first_of_the_surest(spark):
    rows = [(1, "A2", "T", "R", "B2", "T", 0.6, 1, "s1"), (2, "A2", "U", "R", "B2", "T", 0.9, 2, "s2"), (3, "A2", "V", "R", "B2", "T", 0.9, 3, "s3"), (4, "A2", "T", "R", "C2", "T", 0.4, 4, "s4"), (5, "1.5", "T", "R", "C2", "T", 0.9, 4, "s")]
    df = spark.createDataFrame(rows, "triple_id long, subject string, subject_type string, relation string, obj string, obj_type string, confidence double, source_id long, source_text string")
    got = triples.dedup(df).collect()
    assert [(r.obj, r.frequency, r.confidence, r.source_id, r.subject_type, r.weight) for r in got] == [("B2", 3, 0.9, 2, "U", 2.7)]


def test_incremental_merge(spark):
    nodes = spark.createDataFrame([("A", "T")], "node string, entity_type string")
    edges = spark.createDataFrame([("A", "B", "R", 0.5, 1, 0.5, 1)], "src string, dst string, relation string, confidence double, frequency long, weight double, source_id long")
    new = spark.createDataFrame([(1, "A", "X", "R", "C", "Y", 0.7, 2), (2, "A", "X", "R", "C", "Z", 0.7, 2)], "ord long, subject string, subject_type string, relation string, obj string, obj_type string, confidence double, source_id long")
    n, e = graph.merge_incremental(nodes, edges, new)
    assert sorted(map(tuple, n.collect())) == [("A", "T"), ("C", "Y")] and e.count() == 3
