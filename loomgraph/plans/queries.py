"""Registry of the core queries: Spark plans over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as tx
from loomgraph.operators import bio, graph, ner, relations, reporting, spans, training, triples
from loomgraph.plans import rules
from loomgraph.plans import span_sql as sq
from loomgraph.plans.runtime import ensure_checkpoint_dir, materialize, table
from loomgraph.sources import readers
from loomgraph.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- shared SQL --------------------------------------------------------------------------------


_strip, _entity_sql = sq.strip, sq.entity


def _filled(x: str, default: str) -> str:
    return f"coalesce(nullif({_strip(f'''coalesce(nullif({x},''),'{default}')''')},''),'{default}')"


_CLEAN = f"""
c AS (SELECT * FROM (
  SELECT triple_id AS ord, {_strip("coalesce(subject,'')")} AS subject, {_strip("coalesce(obj,'')")} AS object,
    {_filled("subject_type", "UNKNOWN")} AS subject_type, {_filled("obj_type", "UNKNOWN")} AS object_type,
    {_filled("relation", "LIEN_QUAN")} AS relation, coalesce(confidence, 1.0) AS weight, CAST(1 AS BIGINT) AS frequency, source_id
  FROM triples) WHERE subject <> '' AND object <> '' AND subject <> object)"""
_EDGES = _CLEAN + ", e AS (SELECT subject AS src, object AS dst, sum(weight) AS weight FROM c GROUP BY 1, 2)"
_ENDS = "SELECT subject AS node, subject_type AS t, ord * 2 AS o FROM c UNION ALL SELECT object, object_type, ord * 2 + 1 FROM c"
_VALID = rf"""
v AS (SELECT * FROM triples WHERE confidence >= 0.5
  AND length({_strip("subject")}) > 1 AND length({_strip("obj")}) > 1
  AND NOT regexp_matches(subject, '^[\p{{Nd}}\s\p{{Z}}.,;:\-/]+$') AND NOT regexp_matches(obj, '^[\p{{Nd}}\s\p{{Z}}.,;:\-/]+$'))"""
_FINAL = _VALID + """,
f AS (SELECT min(triple_id) AS ord, subject, relation, obj, arg_max(struct_pack(v := subject_type), k).v AS subject_type, arg_max(struct_pack(v := obj_type), k).v AS obj_type, max(confidence) AS confidence,
  count(*) AS frequency, arg_max(struct_pack(v := source_id), k).v AS source_id, arg_max(struct_pack(v := left(source_text, 120)), k).v AS source_text
  FROM (SELECT *, row_number() OVER (PARTITION BY subject, relation, obj ORDER BY confidence, triple_id DESC) AS k FROM v) GROUP BY subject, relation, obj)"""


# ---- triples and graph -------------------------------------------------------------------------


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return triples.clean(table(spark, d, "triples"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return _clean(spark, d).groupBy(F.col("subject").alias("src"), F.col("object").alias("dst")).agg(F.sum("weight").alias("weight"))


def _final(spark: SparkSession, d: str) -> DataFrame:
    return triples.dedup(table(spark, d, "triples"))


def _multi(spark: SparkSession, d: str) -> DataFrame:
    return _final(spark, d).withColumnsRenamed({"subject": "src", "obj": "dst"})


@query(f"WITH {_CLEAN} SELECT ord, subject, subject_type, relation, object, object_type, weight, frequency, source_id FROM c")
def q_triples_clean(spark, d):
    return _clean(spark, d).select("ord", "subject", "subject_type", "relation", "object", "object_type", "weight", "frequency", "source_id")


@query(
    f"WITH {_CLEAN}, r AS (SELECT subject, object, relation, sum(weight) AS w, sum(frequency) AS f, count(*) AS n FROM c GROUP BY 1, 2, 3) "
    "SELECT subject, object, round(sum(w), 4) AS weight, CAST(sum(f) AS BIGINT) AS frequency, CAST(sum(n) AS BIGINT) AS triple_count, "
    "string_agg(relation || ':' || n, '|' ORDER BY relation) AS relations FROM r GROUP BY 1, 2"
)
def q_edges_collapse(spark, d):
    entries = F.transform(F.map_entries("relations"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return triples.collapse(_clean(spark, d)).select("subject", "object", F.round("weight", 4).alias("weight"), "frequency", "triple_count", F.array_join(entries, "|").alias("relations"))


@query(
    f"WITH {_FINAL} SELECT subject, obj, coalesce(string_agg(DISTINCT relation, '|' ORDER BY relation), '') AS relation, round(max(confidence), 4) AS confidence, "
    "CAST(sum(frequency) AS BIGINT) AS frequency, round(sum(round(frequency * confidence, 4)), 4) AS weight FROM f GROUP BY 1, 2"
)
def q_edges_export(spark, d):
    return triples.collapse_export(_final(spark, d))


@query(f"WITH {_CLEAN}, ends AS ({_ENDS}) SELECT node, arg_min(t, o) AS entity_type FROM ends GROUP BY 1")
def q_node_types_first(spark, d):
    return triples.node_types(_clean(spark, d), upgrade=False).select("node", "entity_type")


@query(f"WITH {_CLEAN}, ends AS ({_ENDS}) SELECT node, coalesce(arg_min(t, o) FILTER (WHERE t <> 'UNKNOWN'), 'UNKNOWN') AS entity_type FROM ends GROUP BY 1")
def q_node_types_upgrade(spark, d):
    return triples.node_types(_clean(spark, d), upgrade=True).select("node", "entity_type")


_DEGREE = "deg AS (SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY 1)"


@query(f"WITH {_EDGES}, {_DEGREE} SELECT * FROM deg")
def q_degree(spark, d):
    return graph.degrees(_edges(spark, d))


@query(f"WITH {_FINAL}, e AS (SELECT subject AS src, obj AS dst FROM f), {_DEGREE} SELECT * FROM deg")
def q_degree_multi(spark, d):
    return graph.degrees(_multi(spark, d))


@query(f"WITH {_EDGES}, {_DEGREE} SELECT degree, count(*) AS nodes, CAST(coalesce(sum(count(*)) OVER (ORDER BY degree DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_rank FROM deg GROUP BY degree")
def q_degree_series(spark, d):
    return reporting.degree_series(graph.degrees(_edges(spark, d)))


def _typed_degrees(spark, d):
    types = triples.node_types(_clean(spark, d), upgrade=False)
    return types.join(graph.degrees(_edges(spark, d)), "node")


_TYPED = f"{_EDGES}, {_DEGREE}, ends AS ({_ENDS}), td AS (SELECT node, arg_min(t, o) AS entity_type, min(o) AS ord, any_value(degree) AS degree FROM ends JOIN deg USING (node) GROUP BY node)"


@query(f"WITH {_TYPED} SELECT node, entity_type, degree FROM td ORDER BY degree DESC, ord LIMIT 20")
def q_top_degree_nodes(spark, d):
    return _typed_degrees(spark, d).orderBy(F.desc("degree"), "ord").limit(20).select("node", "entity_type", "degree")


@query(
    f"WITH {_TYPED}, t AS (SELECT node FROM td ORDER BY degree DESC, ord LIMIT 30) "
    "SELECT src, dst, round(weight, 4) AS weight FROM e WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t)"
)
def q_topk_subgraph(spark, d):
    return graph.top_subgraph(_edges(spark, d), _typed_degrees(spark, d), 30).select("src", "dst", F.round("weight", 4).alias("weight"))


@query(f"WITH {_FINAL} SELECT subject AS src, obj AS dst, arg_min(struct_pack(r := relation), ord).r AS relation, arg_min(confidence, ord) AS confidence, arg_min(frequency, ord) AS frequency FROM f GROUP BY 1, 2")
def q_edge_pick(spark, d):
    return graph.first_parallel(_multi(spark, d)).select("src", "dst", "relation", "confidence", "frequency")


_RANKS = 40


def _ranks_sql() -> str:
    """Power iteration from the uniform vector, unrolled; the first vector that moved by less than the bound counts."""
    steps = """
n AS MATERIALIZED (SELECT CAST(count(*) AS DOUBLE) AS n FROM nd),
wout AS MATERIALIZED (SELECT src, sum(weight) AS w FROM e GROUP BY 1),
lk AS MATERIALIZED (SELECT e.src, dst, weight / w AS share FROM e JOIN wout USING (src)),
r0 AS MATERIALIZED (SELECT node, 1 / n AS x, 1e9 AS moved FROM nd, n)"""
    for k in range(1, _RANKS + 1):
        steps += f""",
r{k} AS MATERIALIZED (SELECT node, y AS x, sum(abs(y - x)) OVER () AS moved FROM (SELECT r.node, r.x,
  0.85 * (coalesce(g, 0) + (SELECT coalesce(sum(x), 0) FROM r{k - 1} WHERE node NOT IN (SELECT src FROM wout)) / n) + 0.15 / n AS y
  FROM r{k - 1} r CROSS JOIN n LEFT JOIN (SELECT dst, sum(x * share) AS g FROM lk JOIN r{k - 1} z ON z.node = lk.src GROUP BY 1) ON dst = r.node))"""
    every = " UNION ALL ".join(f"SELECT {k} AS k, * FROM r{k}" for k in range(1, _RANKS + 1))
    return steps + f""",
ra AS (SELECT * FROM ({every})),
pr AS MATERIALIZED (SELECT node, x AS pagerank FROM ra WHERE k = (SELECT min(k) FROM ra, n WHERE moved < n * 1e-6))"""


_DEPTH = 60


def _between_sql() -> str:
    """Brandes: numbers of shortest paths level by level from every source, dependencies back from the deepest level."""
    steps = """
bfs(s, v, d, sigma) USING KEY (s, v) AS (SELECT node, node, 0, 1.0::DOUBLE FROM nd UNION
  (SELECT f.s, l.dst, any_value(f.d) + 1, sum(f.sigma) FROM bfs f JOIN l ON l.src = f.v WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs k WHERE k.s = f.s AND k.v = l.dst) GROUP BY f.s, l.dst)),
paths AS MATERIALIZED (SELECT * FROM bfs),
tree AS MATERIALIZED (SELECT a.s, a.v, b.v AS w, a.d, a.sigma / b.sigma AS part FROM paths a JOIN l ON l.src = a.v JOIN paths b ON b.s = a.s AND b.v = l.dst AND b.d = a.d + 1)"""
    steps += f""",
dep{_DEPTH} AS MATERIALIZED (SELECT s, v, CAST(0 AS DOUBLE) AS delta FROM paths WHERE false)"""
    for d in range(_DEPTH - 1, 0, -1):
        steps += f""",
dep{d} AS MATERIALIZED (SELECT t.s, t.v, sum(part * (1 + coalesce(b.delta, 0))) AS delta FROM tree t LEFT JOIN dep{d + 1} b ON b.s = t.s AND b.v = t.w WHERE t.d = {d} GROUP BY 1, 2)"""
    every = " UNION ALL ".join(f"SELECT v, delta FROM dep{d}" for d in range(1, _DEPTH))
    return steps + f""",
bt AS MATERIALIZED (SELECT node, coalesce(delta, 0) / ((SELECT count(*) FROM nd) - 1.0) / ((SELECT count(*) FROM nd) - 2.0) AS betweenness FROM nd LEFT JOIN (SELECT v, sum(delta) AS delta FROM ({every}) GROUP BY 1) ON v = node)"""


_NODES = "nd AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e), l AS MATERIALIZED (SELECT DISTINCT src, dst FROM e)"
_SCC = """
reach(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM reach r JOIN e ON r.b = e.src),
sc AS MATERIALIZED (SELECT node, least(node, coalesce(min(x.b), node)) AS scc FROM nd LEFT JOIN (SELECT p.a, p.b FROM reach p JOIN reach q ON p.a = q.b AND p.b = q.a) x ON x.a = node GROUP BY node)"""
_METRICS_SQL = f"""{_TYPED}, {_NODES},{_ranks_sql()},{_between_sql()},
mx AS MATERIALIZED (SELECT td.node, entity_type, in_degree, out_degree, deg.degree, round(betweenness, 12) AS betweenness, round(pagerank, 10) AS pagerank, ord
  FROM td JOIN deg USING (node) JOIN bt USING (node) JOIN pr USING (node))"""


def _top_sql(key: str, k: int = 20) -> str:
    order = f"{key} DESC, degree DESC, betweenness DESC, pagerank DESC, lower(node) DESC, ord"
    return f"SELECT node, entity_type, in_degree, out_degree, degree, betweenness, pagerank, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank FROM mx ORDER BY {order} LIMIT {k}"


_WCC = """
both_ways AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
cc(node, wcc) USING KEY (node) AS (
  SELECT a, a FROM both_ways GROUP BY a
  UNION
  (SELECT u.node, min(v.wcc) FROM recurring.cc AS u JOIN both_ways ON a = u.node JOIN cc AS v ON b = v.node WHERE v.wcc < u.wcc GROUP BY u.node))"""


@query(f"WITH RECURSIVE {_EDGES}, {_WCC} SELECT node, wcc FROM cc")
def q_wcc(spark, d):
    return graph.measures(_edges(spark, d)).select("node", "wcc")


@query(f"WITH RECURSIVE {_EDGES}, {_WCC} SELECT wcc, count(*) AS nodes FROM cc GROUP BY 1")
def q_component_sizes(spark, d):
    return q_wcc(spark, d).groupBy("wcc").agg(F.count(F.lit(1)).alias("nodes")).orderBy(F.desc("nodes"))


@query(f"WITH RECURSIVE {_EDGES}, {_WCC} SELECT node, wcc FROM cc")
def q_wcc_joins(spark, d):
    """The same components by the iterative joins that serve graphs beyond the local bound."""
    return graph.weak_components(_edges(spark, d))


@query(f"WITH RECURSIVE {_EDGES}, {_NODES}, {_SCC} SELECT node, scc FROM sc")
def q_scc(spark, d):
    return graph.measures(_edges(spark, d)).select("node", "scc")


@query(f"WITH RECURSIVE {_EDGES}, {_NODES},{_ranks_sql()} SELECT node, round(pagerank, 10) AS pagerank FROM pr")
def q_pagerank(spark, d):
    return graph.measures(_edges(spark, d)).select("node", F.round("pagerank", 10).alias("pagerank"))


@query(f"WITH RECURSIVE {_EDGES}, {_NODES},{_between_sql()} SELECT node, round(betweenness, 12) AS betweenness FROM bt")
def q_betweenness(spark, d):
    return graph.any_betweenness(materialize(_edges(spark, d))).select("node", F.round("betweenness", 12).alias("betweenness"))


@query(f"WITH RECURSIVE {_EDGES}, {_NODES},{_between_sql()} SELECT node, round(betweenness, 12) AS betweenness FROM bt")
def q_betweenness_joins(spark, d):
    """The same by iterative joins, as for graphs beyond the bound of the array code; the joins leave a state of too many pairs to it."""
    return graph.betweenness(_edges(spark, d)).select("node", F.round("betweenness", 12).alias("betweenness"))


@query(f"WITH RECURSIVE {_EDGES}, {_NODES},{_ranks_sql()} SELECT node, round(pagerank, 10) AS pagerank FROM pr")
def q_pagerank_joins(spark, d):
    return graph.pagerank(_edges(spark, d)).select("node", F.round("pagerank", 10).alias("pagerank"))


def _metrics(spark, d, edges=None):
    """Node metrics; centralities are rounded before anything is ordered, so that ties do not hang on the order of sums."""
    rows = graph.node_metrics(edges or materialize(_edges(spark, d)), triples.node_types(_clean(spark, d), upgrade=False))
    return materialize(rows.withColumns({"betweenness": F.round("betweenness", 12), "pagerank": F.round("pagerank", 10)}))


def _leaders(spark, d, *keys, k=20):
    """The metrics of all nodes that can be among the first by ``keys``, the numbers of all nodes by hash, and the number of edges; three None where the graph is beyond the bound or two names share a hash.

    Ranks need only numbers; names and types are looked up for the few nodes that lead.
    """
    rows = _clean(spark, d)
    g = graph.hashed(rows.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "weight"))
    if g is None:
        return None, None, None
    numbers = materialize(graph.number_metrics(g).withColumns({"betweenness": F.round("betweenness", 12), "pagerank": F.round("pagerank", 10)}))
    few = materialize(graph.leaders(numbers, keys, k))
    among = F.broadcast(few) if few.count() <= reporting.FEW_KEYS else few
    types = triples.node_types(rows, upgrade=False, among=among)
    found = types.withColumn("id", F.xxhash64("node")).join(few, "id").select("node", "entity_type", "in_degree", "out_degree", "degree", "betweenness", "pagerank", "ord")
    return materialize(found), numbers, len(g.src)


@query(f"WITH RECURSIVE {_METRICS_SQL} SELECT node, entity_type, in_degree, out_degree, degree, betweenness, pagerank FROM mx")
def q_node_metrics(spark, d):
    return _metrics(spark, d).orderBy(*graph.base_order()).drop("ord")


def _top(spark, d, key):
    metrics = _leaders(spark, d, key)[0]
    return graph.top(_metrics(spark, d) if metrics is None else metrics, key).drop("ord")


@query(f"WITH RECURSIVE {_METRICS_SQL} {_top_sql('degree')}")
def q_top_degree(spark, d):
    return _top(spark, d, "degree")


@query(f"WITH RECURSIVE {_METRICS_SQL} {_top_sql('betweenness')}")
def q_top_betweenness(spark, d):
    return _top(spark, d, "betweenness")


@query(f"WITH RECURSIVE {_METRICS_SQL} {_top_sql('pagerank')}")
def q_top_pagerank(spark, d):
    return _top(spark, d, "pagerank")


def _kinds(spark, d):
    return _clean(spark, d).agg(F.count_distinct("relation")).first()[0]


def _summary(spark, d, edges=None):
    edges = edges or materialize(_edges(spark, d))
    return graph.summary(edges, materialize(graph.measures(edges)), _kinds(spark, d))


@query(
    f"WITH RECURSIVE {_EDGES}, {_WCC} SELECT (SELECT count(*) FROM cc) AS nodes, (SELECT count(*) FROM e) AS edges_unique, "
    "round((SELECT count(*) FROM e) / ((SELECT count(*) FROM cc) * ((SELECT count(*) FROM cc) - 1.0)), 12) AS density, (SELECT count(DISTINCT wcc) FROM cc) AS weakly_connected_components, "
    "(SELECT count(DISTINCT relation) FROM c) AS relation_types, (SELECT max(n) FROM (SELECT count(*) AS n FROM cc GROUP BY wcc)) AS largest_wcc"
)
def q_graph_totals(spark, d):
    return _summary(spark, d).select("nodes", "edges_unique", F.round("density", 12).alias("density"), "weakly_connected_components", "relation_types", "largest_wcc")


@query(f"WITH RECURSIVE {_EDGES}, {_NODES}, {_WCC}, {_SCC} SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM e) AS edges_unique, "
    "round((SELECT count(*) FROM e) / ((SELECT count(*) FROM nd) * ((SELECT count(*) FROM nd) - 1.0)), 12) AS density, (SELECT count(DISTINCT scc) FROM sc) AS strongly_connected_components, "
    "(SELECT count(DISTINCT wcc) FROM cc) AS weakly_connected_components, (SELECT count(DISTINCT relation) FROM c) AS relation_types, (SELECT max(n) FROM (SELECT count(*) AS n FROM cc GROUP BY wcc)) AS largest_wcc")
def q_graph_summary(spark, d):
    return _summary(spark, d).withColumn("density", F.round("density", 12))


def _report_sql() -> str:
    parts = ["SELECT 0 AS no, 'Input: triples' || chr(10) || 'Graph: ' || (SELECT count(*) FROM nd) || ' nodes, ' || (SELECT count(*) FROM e) || ' unique directed edges' || chr(10) || 'Output: report' AS line"]
    for at, (label, key) in enumerate((("Degree", "degree"), ("Betweenness", "betweenness"), ("PageRank", "pagerank")), 1):
        parts.append(f"SELECT {1000 * at}, chr(10) || 'Top 20 by {label}:'")
        parts.append(f"SELECT {1000 * at} + rank, format('{{{{:>2d}}}}. {{{{}}}} | type={{{{}}}} | degree={{{{}}}} | betweenness={{{{:.6f}}}} | pagerank={{{{:.6f}}}}', rank, node, entity_type, degree, betweenness, pagerank) FROM ({_top_sql(key, 10)})".replace("{{", "{").replace("}}", "}"))
    return " UNION ALL ".join(parts)


@query(f"WITH RECURSIVE {_METRICS_SQL} " + _report_sql())
def q_console_report(spark, d):
    metrics, numbers, m = _leaders(spark, d, "degree", "betweenness", "pagerank")
    if metrics is not None:
        totals = numbers.agg(F.count(F.lit(1)).alias("nodes"), F.lit(m).cast("bigint").alias("edges_unique"))
        return reporting.console_report(metrics, totals, "triples", "report")
    edges = materialize(_edges(spark, d))
    return reporting.console_report(_metrics(spark, d, edges), _summary(spark, d, edges), "triples", "report")


@query()
def q_summary_document(spark, d):
    metrics, numbers, m = _leaders(spark, d, "degree", "betweenness", "pagerank")
    if metrics is not None:
        return graph.summary_document(graph.summary(m, numbers, _kinds(spark, d)), metrics)
    edges = materialize(_edges(spark, d))
    return graph.summary_document(_summary(spark, d, edges), _metrics(spark, d, edges))


@query(f"WITH {_VALID} SELECT triple_id, subject, relation, obj, confidence FROM v")
def q_triple_filter(spark, d):
    return triples.valid(table(spark, d, "triples")).select("triple_id", "subject", "relation", "obj", "confidence")


@query(f"WITH {_FINAL} SELECT ord, subject, subject_type, relation, obj, obj_type, confidence, frequency, round(frequency * confidence, 4) AS weight, source_id, source_text FROM f")
def q_triple_dedup(spark, d):
    return _final(spark, d)


@query(f"WITH {_FINAL} SELECT subject, relation, obj, frequency FROM f WHERE frequency >= 2")
def q_triple_frequent(spark, d):
    return triples.dedup(table(spark, d, "triples"), least_freq=2).select("subject", "relation", "obj", "frequency")


@query(
    f"WITH {_FINAL} SELECT subject, subject_type, relation, obj AS object, obj_type AS object_type, round(confidence, 4) AS confidence, frequency, "
    "round(frequency * confidence, 4) AS weight, source_id, source_text FROM f"
)
def q_triple_export(spark, d):
    return triples.export_rows(_final(spark, d))


@query(f"WITH {_FINAL} SELECT count(DISTINCT source_id) AS sources, round(count(DISTINCT source_id) / CAST((SELECT count(*) FROM articles) AS DOUBLE), 6) AS share FROM f")
def q_coverage(spark, d):
    return triples.coverage(_final(spark, d), table(spark, d, "articles").count())


@query(f"WITH {_FINAL} SELECT round(avg(confidence), 6) AS mean, round(median(confidence), 6) AS median, min(confidence) AS least FROM f")
def q_conf_stats(spark, d):
    return triples.confidence_stats(_final(spark, d))


@query(f"WITH {_FINAL} SELECT relation, count(*) AS n FROM f GROUP BY 1")
def q_relation_dist(spark, d):
    return triples.counts_by(_final(spark, d), "relation")


@query(
    f"WITH {_FINAL} SELECT 'rules' AS model, count(*) AS total_triples, count(*) AS total_edges, (SELECT count(*) FROM (SELECT subject FROM f UNION SELECT obj FROM f)) AS total_nodes, "
    "string_agg(DISTINCT relation, '|' ORDER BY relation) AS relation_types, "
    "(SELECT string_agg(t, '|' ORDER BY t) FROM (SELECT subject_type AS t FROM f UNION SELECT obj_type FROM f) WHERE t IS NOT NULL) AS entity_types, CAST(0.7 AS DOUBLE) AS min_ner_score, CAST(0.5 AS DOUBLE) AS min_confidence FROM f"
)
def q_metadata(spark, d):
    meta = triples.metadata(_final(spark, d), "rules", 0.70, 0.50)
    return meta.withColumns({c: F.array_join(c, "|") for c in ("relation_types", "entity_types")})


def _coloured(x: str, table: dict[str, str], other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{other}' END"


@query(f"WITH {_TYPED}, m AS (SELECT max(degree) AS most FROM td) SELECT node, entity_type, degree, {_coloured('entity_type', rules.TYPE_COLOURS, '#CCCCCC')} AS colour, round(10 + 40 * degree / most, 6) AS size FROM td, m")
def q_styled_nodes(spark, d):
    return reporting.styled_nodes(_typed_degrees(spark, d))


@query(f"WITH {_FINAL} SELECT subject AS src, obj AS dst, relation, frequency, {_coloured('relation', rules.RELATION_COLOURS, '#888888')} AS colour, round(greatest(1.0, ln(1 + frequency)), 6) AS width FROM f")
def q_styled_edges(spark, d):
    return reporting.styled_edges(_multi(spark, d))


@query()
def q_sample_per_relation(spark, d):
    return reporting.sample_per_group(_final(spark, d), "relation", "ord", 3)


@query()
def q_sample_rows(spark, d):
    return reporting.sample_rows(table(spark, d, "articles").select("id", "title"), "id", 8)


@query("SELECT id, title FROM articles ORDER BY id, ingested_at LIMIT 100")
def q_first_rows(spark, d):
    return table(spark, d, "articles").orderBy("id", "ingested_at").select("id", "title").limit(100)


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) AS total FROM articles" for c in ("id", "title", "content", "text", "published_at"))
)
def q_missing_profile(spark, d):
    return reporting.missing_profile(table(spark, d, "articles"), ["id", "title", "content", "text", "published_at"])


_LINES = """
l AS (SELECT triple_id, subject, subject_type, relation, obj, obj_type, confidence FROM (
  SELECT triple_id, json_extract_string(j, '$.subject') AS subject, json_extract_string(j, '$.subject_type') AS subject_type, json_extract_string(j, '$.relation') AS relation,
    coalesce(json_extract_string(j, '$.obj'), json_extract_string(j, '$.object')) AS obj, coalesce(json_extract_string(j, '$.obj_type'), json_extract_string(j, '$.object_type')) AS obj_type,
    CAST(json_extract_string(j, '$.confidence') AS DOUBLE) AS confidence
  FROM (SELECT triple_id, CASE WHEN json_valid(line) THEN line::JSON END AS j FROM triple_lines) WHERE j IS NOT NULL))"""


@query(f"WITH {_LINES} SELECT * FROM l")
def q_json_lines(spark, d):
    return readers.json_triple_lines(table(spark, d, "triple_lines")).select("triple_id", "subject", "subject_type", "relation", "obj", "obj_type", "confidence")


def _merged(spark, d):
    final = _final(spark, d)
    nodes = triples.node_types(final, True, dst="obj", dst_type="obj_type")
    edges = _multi(spark, d).select("src", "dst", "relation", "confidence", "frequency", "weight", "source_id")
    new = readers.json_triple_lines(table(spark, d, "triple_lines")).where("subject is not null and obj is not null").withColumn("ord", F.col("triple_id"))
    return graph.merge_incremental(nodes, edges, new)


@query(
    f"WITH {_FINAL}, {_LINES}, g AS (SELECT * FROM l WHERE subject IS NOT NULL AND obj IS NOT NULL), "
    "old AS (SELECT node, coalesce(arg_min(t, o) FILTER (WHERE t <> 'UNKNOWN'), 'UNKNOWN') AS entity_type FROM (SELECT subject AS node, subject_type AS t, ord * 2 AS o FROM f UNION ALL SELECT obj, obj_type, ord * 2 + 1 FROM f) GROUP BY 1), "
    "fresh AS (SELECT node, arg_min(struct_pack(t := t), o).t AS entity_type FROM (SELECT subject AS node, subject_type AS t, triple_id * 2 AS o FROM g UNION ALL SELECT obj, obj_type, triple_id * 2 + 1 FROM g) "
    "WHERE node NOT IN (SELECT node FROM old) GROUP BY 1) SELECT * FROM old UNION ALL SELECT * FROM fresh"
)
def q_incremental_nodes(spark, d):
    return _merged(spark, d)[0]


@query(
    f"WITH {_FINAL}, {_LINES} SELECT subject AS src, obj AS dst, relation, confidence, frequency, round(frequency * confidence, 4) AS weight FROM f UNION ALL "
    "SELECT subject, obj, relation, confidence, 1, confidence FROM l WHERE subject IS NOT NULL AND obj IS NOT NULL"
)
def q_incremental_merge(spark, d):
    return _merged(spark, d)[1].drop("source_id")


# ---- text ----------------------------------------------------------------------------------------

_quoted, _NORMAL = sq.quoted, sq.normal("text")


@query(f"SELECT rec_id, {_NORMAL} AS normal FROM sentence_records")
def q_normalize_text(spark, d):
    return table(spark, d, "sentence_records").select("rec_id", tx.normalize_text(F.col("text")).alias("normal"))


@query(f"SELECT span_id, {_entity_sql('text')} AS name FROM entity_spans")
def q_normalize_entity(spark, d):
    return table(spark, d, "entity_spans").select("span_id", tx.normalize_entity(F.col("text"), compose=False).alias("name"))


@query("SELECT span_id, coalesce(m.v, text) AS canonical FROM entity_spans LEFT JOIN (VALUES " + ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in rules.CANONICAL.items()) + r") AS m(k, v) ON m.k = regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')")
def q_canonicalize(spark, d):
    return table(spark, d, "entity_spans").select("span_id", tx.canonicalize(F.col("text")).alias("canonical"))


@query("WITH f AS (SELECT id, unnest([struct_pack(field_no := 0, field := 'title', body := title), struct_pack(field_no := 1, field := 'content', body := content), struct_pack(field_no := 2, field := 'text', body := text)]) AS x FROM articles), "
    "a AS (SELECT id AS row_id, x.field_no AS field_no, x.field AS field, coalesce(x.body, '') AS body FROM f), "
    + sq.packs("body", "row_id, field_no, field", "a") + " SELECT row_id, field_no, field, CAST(sent_no AS INTEGER) AS sent_no, text FROM packed")
def q_split_sentences(spark, d):
    """Greedy sentence packs of all article fields."""
    return ner.sentence_rows(table(spark, d, "articles").select("id", "title", "content", "text"))


@query("WITH " + sq.chunks("coalesce(content, '')", "id", "articles") + " SELECT id, CAST(chunk_no AS INTEGER) AS chunk_no, chunk, CAST(start AS INTEGER) AS start FROM chunked")
def q_model_chunks(spark, d):
    chunks = F.posexplode(tx.model_chunks(F.coalesce("content", F.lit(""))))
    return table(spark, d, "articles").select("id", chunks.alias("chunk_no", "c")).select("id", "chunk_no", "c.chunk", "c.start")


@query(
    "SELECT rec_id, len(list_filter(entities, lambda x: x.score >= 0.7 AND coalesce(x.etype, '') NOT IN ('', 'O') AND regexp_matches(x.text, '[^\\s\\p{Z}]'))) AS n FROM sentence_records WHERE entities IS NOT NULL"
)
def q_entity_filter(spark, d):
    return table(spark, d, "sentence_records").where("entities is not null").select("rec_id", F.size(ner.kept(F.col("entities"))).cast("bigint").alias("n"))


@query(f"WITH x AS (SELECT rec_id, unnest(entities) AS e FROM sentence_records WHERE entities IS NOT NULL), n AS (SELECT rec_id, nfc_normalize(e.text) AS raw, {sq.entity("nfc_normalize(e.text)")} AS name FROM x) "
    "SELECT rec_id, CAST(count(*) FILTER (WHERE name <> '' AND name <> raw) AS INTEGER) AS n_changed, CAST(count(*) FILTER (WHERE name = '') AS INTEGER) AS n_dropped, CAST(count(*) FILTER (WHERE name <> '') AS INTEGER) AS n_left FROM n GROUP BY 1 HAVING n_left > 0")
def q_entity_pass(spark, d):
    rows = table(spark, d, "sentence_records").select("rec_id", "row_id", "text", "entities").where("entities is not null")
    return ner.normalized(rows).select("rec_id", "n_changed", "n_dropped", F.size("entities").alias("n_left"))


@query(
    "SELECT count(*) AS sentences, round(count(*) / CAST(count(DISTINCT row_id) AS DOUBLE), 6) AS per_article, CAST(sum(coalesce(len(entities), 0)) AS BIGINT) AS entities FROM sentence_records"
)
def q_sentence_stats(spark, d):
    rows = table(spark, d, "sentence_records").withColumn("entities", F.coalesce("entities", F.array().cast(ner.ENTITIES)))
    return reporting.sentence_stats(rows)


def _texts(spark, d):
    return table(spark, d, "sentence_records").select("rec_id", "row_id", "field_name", tx.normalize_text(F.col("text")).alias("text"), F.coalesce("entities", F.array().cast(ner.ENTITIES)).alias("entities"))


def _entries(spark, d):
    return spans.dictionary_entries(table(spark, d, "gazetteer"))


def _rows_of(df: DataFrame, column: str) -> DataFrame:
    return df.select("rec_id", F.explode(column).alias("s")).select("rec_id", "s.start", "s.end", "s.etype")


@query()
def q_regex_spans(spark, d):
    return _rows_of(_texts(spark, d).select("rec_id", spans.regex_spans(F.col("text")).alias("spans")), "spans")


@query()
def q_regex_spans_basic(spark, d):
    return _rows_of(_texts(spark, d).select("rec_id", spans.regex_spans(F.col("text"), rules.FAMILIES_BASIC).alias("spans")), "spans")


@query(f"WITH {sq.TEXTS},{sq.DICTIONARY} SELECT rec_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\", etype FROM dict")
def q_gazetteer_spans(spark, d):
    return _rows_of(_texts(spark, d).select("rec_id", spans.dictionary_spans(F.col("text"), _entries(spark, d)).alias("spans")), "spans")


@query(f"WITH {sq.TEXTS},{sq.DICTIONARY} SELECT rec_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\", etype FROM dict")
def q_gazetteer_spans_join(spark, d):
    """The same by a join, as for dictionaries beyond the bound of the automaton."""
    return _rows_of(spans.joined_dictionary_spans(_texts(spark, d).select("rec_id", "text"), "rec_id", "text", table(spark, d, "gazetteer")), "spans")


@query(
    f"""WITH {sq.TEXTS}, terms AS (SELECT unnest([{sq.listed(rules.INDUSTRY_NEEDS_CONTEXT)}]) AS term),
h AS (SELECT rec_id, lower(text) AS low, term, string_split(lower(text), term) AS parts FROM t JOIN terms ON contains(lower(text), term)),
p AS (SELECT rec_id, low, term, CAST(unnest(list_transform(range(1, len(parts)), lambda k: list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * length(term))) AS BIGINT) AS start FROM h),
w AS (SELECT *, substr(low, greatest(start - 49, 1), least(start, 50)) AS w1, substr(low, start + 1, 50) AS w2 FROM p)
SELECT rec_id, term, start, {" OR ".join(f"contains(w1, {sq.quoted(t)}) OR contains(w2, {sq.quoted(t)})" for t in rules.INDUSTRY_TRIGGERS)} AS has_context FROM w"""
)
def q_industry_context(spark, d):
    """Every place of every term that needs a trigger word nearby."""
    terms = F.array(*[F.lit(t) for t in rules.INDUSTRY_NEEDS_CONTEXT])
    rows = _texts(spark, d).select("rec_id", "text", F.explode(terms).alias("term")).where(F.contains(F.lower("text"), F.col("term")))
    parts = rows.withColumn("parts", F.expr("split(lower(text), term, -1)"))
    sizes = F.expr("transform(sequence(1, size(parts) - 1), k -> aggregate(slice(parts, 1, k), 0, (n, x) -> n + length(x)) + (k - 1) * length(term))")
    places = parts.select("rec_id", "text", "term", F.explode(sizes).alias("at"))
    return places.select("rec_id", "term", F.col("at").cast("bigint").alias("start"), spans.industry_context(F.col("text"), F.col("at")).alias("has_context"))


# Sentences and the spans that the pattern families find in them.
_CASES = {
    "Ngày 16/1, GDP tăng 6,5% trong năm 2024. Giá 1000 USD, tương đương 12 triệu đồng.": [
        ("12 triệu đồng", "MONEY"), ("1000 USD", "MONEY"), ("12 triệu", "MONEY"), ("Ngày 16/1", "DATE"), ("năm 2024", "DATE"), ("6,5%", "PERCENT"), ("tăng 6,5%", "PERCENT"),
    ],
    "watchOS 26": [], "iOS 17": [("iOS 17", "PRODUCT")], "tăng ２０ % và ５００ tỷ đồng": [("５００ tỷ đồng", "MONEY"), ("５００ tỷ", "MONEY"), ("２０ %", "PERCENT"), ("tăng ２０ %", "PERCENT")],
}


@query("SELECT * FROM (VALUES " + ", ".join(f"({sq.quoted(t)}, {sq.quoted(x)}, '{k}')" for t, found in _CASES.items() for x, k in found) + ") AS v(text, found, etype)")
def q_regex_cases(spark, d):
    """The pattern families on sentences with known spans (the patterns look around, which SQL cannot)."""
    rows = spark.createDataFrame([(t,) for t in _CASES], "text string").withColumn("s", F.explode(spans.regex_spans(F.col("text"))))
    return rows.select("text", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("found"), F.col("s.etype").alias("etype"))


def _resolved(spark, d, *more):
    texts = _texts(spark, d)
    found = F.concat(spans.model_spans(F.col("text"), F.col("entities")), *more, spans.dictionary_spans(F.col("text"), _entries(spark, d)))
    return texts.withColumn("found", found).withColumn("spans", spans.resolve_overlaps(F.col("found")))


@query(f"WITH {sq.SPANS} SELECT rec_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\", etype FROM sp")
def q_resolve_overlaps(spark, d):
    """Model and dictionary spans."""
    return _rows_of(_resolved(spark, d), "spans")


@query(f"WITH {sq.TEXTS},{sq.MODEL} SELECT rec_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\", etype FROM model")
def q_model_spans(spark, d):
    return _rows_of(_texts(spark, d).select("rec_id", spans.model_spans(F.col("text"), F.col("entities")).alias("spans")), "spans")


@query()
def q_hybrid_spans(spark, d):
    """Spans of all three sources."""
    return _rows_of(_resolved(spark, d, spans.regex_spans(F.col("text"))), "spans")


@query(f"WITH {sq.TEXTS},{sq.TOKENS} SELECT rec_id, CAST(i AS INTEGER) AS i, token, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\" FROM toks")
def q_tokens(spark, d):
    rows = _texts(spark, d).select("rec_id", F.posexplode(bio.tokens("text")).alias("i", "t"))
    return rows.select("rec_id", "i", "t.token", "t.start", "t.end")


def _labelled(spark, d):
    """Labels by model and dictionary spans."""
    toks = _resolved(spark, d).withColumn("toks", bio.tokens("text"))
    return materialize(toks.select("rec_id", "row_id", "field_name", "text", bio.spans_to_bio(F.col("toks"), F.col("spans")).alias("bio")))


@query(f"WITH {sq.BIO} SELECT rec_id, CAST(i AS INTEGER) AS i, token, label FROM bio")
def q_bio(spark, d):
    return _labelled(spark, d).select("rec_id", F.posexplode("bio").alias("i", "x")).select("rec_id", "i", "x.token", "x.label")


@query(f"WITH {sq.BIO} SELECT rec_id, coalesce(string_agg(token || ' ' || label, chr(10) ORDER BY i), '') AS lines, CAST(count(token) AS INTEGER) AS n FROM t LEFT JOIN bio USING (rec_id) GROUP BY rec_id")
def q_bio_string(spark, d):
    """BIO as text and read back."""
    coded = _labelled(spark, d).select("rec_id", bio.to_string(F.col("bio")).alias("lines"))
    return coded.select("rec_id", "lines", F.size(bio.from_string(F.col("lines"))).alias("n"))


def _fixed(spark, d):
    return materialize(_labelled(spark, d).withColumn("fixed", bio.fixed(F.col("bio"))))


@query(f"WITH {sq.FIXED} SELECT rec_id, CAST(i AS INTEGER) AS i, token, label FROM fixed")
def q_bio_fix(spark, d):
    return _fixed(spark, d).select("rec_id", F.posexplode("fixed").alias("i", "x")).select("rec_id", "i", "x.token", "x.label")


@query(f"WITH {sq.ISLANDS} SELECT rec_id, CAST(i AS INTEGER) AS i, text, canonical, type FROM entities")
def q_entities_from_bio(spark, d):
    return _fixed(spark, d).select("rec_id", F.posexplode(bio.decode_canonical(F.col("fixed"))).alias("i", "e")).select("rec_id", "i", "e.text", "e.canonical", "e.type")


@query()
def q_ner_records(spark, d):
    out = bio.records(_fixed(spark, d), "rec_id", "field_name", "text", "fixed")
    return out.select("id", "source_field", F.to_json(F.struct("*")).alias("record"))


@query(f"WITH {sq.FIXED} SELECT substr(label, 3) AS etype, count(*) AS n FROM fixed WHERE left(label, 2) = 'B-' GROUP BY 1")
def q_entity_dist(spark, d):
    return bio.entity_counts(_fixed(spark, d), "fixed")


@query(f"WITH {sq.FIXED}, n AS (SELECT label, count(*) AS n FROM fixed GROUP BY 1) SELECT label, n, round(n / CAST((SELECT sum(n) FROM n) AS DOUBLE) * 100, 4) AS pct FROM n")
def q_label_dist(spark, d):
    return bio.label_counts(_fixed(spark, d), "fixed")


@query(f"WITH {sq.FIXED}, a AS (SELECT label, count(*) AS n FROM bio WHERE label <> 'O' GROUP BY 1), b AS (SELECT label, count(*) AS n FROM fixed WHERE label <> 'O' GROUP BY 1) SELECT label, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b USING (label)")
def q_label_delta(spark, d):
    return bio.label_delta(_fixed(spark, d), "bio", "fixed")


@query(f"WITH {sq.FIXED} SELECT rec_id, text FROM t WHERE field_name = 'title' AND rec_id NOT IN (SELECT rec_id FROM fixed WHERE left(label, 2) = 'B-')")
def q_no_entity(spark, d):
    return bio.without_entity(_fixed(spark, d), "fixed").where("field_name = 'title'").select("rec_id", "text")


# ---- relations -----------------------------------------------------------------------------------


def _records(spark, d):
    rows = table(spark, d, "sentence_records").where("entities is not null")
    return rows.select(F.col("rec_id").alias("row_id"), tx.normalize_text(F.col("text")).alias("text"), "entities")


@query(f"WITH {sq.relations_sql()} SELECT subject, subject_type, relation, obj, obj_type, confidence, rec_id AS source_id, source_text FROM rel WHERE relation = '{rules.CO_OCCURRENCE}'")
def q_cooccur(spark, d):
    return relations.cooccurrence(_records(spark, d))


@query("WITH ents AS (SELECT row_id, list(struct_pack(text := text, etype := etype) ORDER BY span_id) FILTER (WHERE etype IN ('PERSON', 'ORGANIZATION')) AS ents FROM entity_spans WHERE text IS NOT NULL GROUP BY 1), "
    f"m AS (SELECT triple_id, subject, {sq.best_match('subject', 'ents')} AS m FROM triples JOIN ents ON ents.row_id = source_id WHERE subject IS NOT NULL) SELECT triple_id, subject, m.text AS matched, m.etype AS etype FROM m WHERE m IS NOT NULL")
def q_best_match(spark, d):
    """For every triple its subject's best match among the entities of the records of its article."""
    ents = table(spark, d, "entity_spans").where("text is not null").groupBy("row_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("span_id", "text", "etype"))), lambda e: F.struct(e["text"].alias("text"), e["etype"].alias("etype"))).alias("entities")
    )
    rows = table(spark, d, "triples").where("subject is not null").select("triple_id", "subject", F.col("source_id").alias("row_id")).join(ents, "row_id")
    match = relations.best_entity_match(F.col("subject"), F.col("entities"), ("PERSON", "ORGANIZATION"))
    return rows.select("triple_id", "subject", match.alias("m")).where("m is not null").select("triple_id", "subject", F.col("m.text").alias("matched"), F.col("m.etype").alias("etype"))


@query(f"WITH {sq.relations_sql()} SELECT subject, subject_type, relation, obj, obj_type, confidence, rec_id AS source_id, source_text FROM rel")
def q_relations(spark, d):
    return relations.triples(_records(spark, d)).drop("emit_no")


@query(f"""WITH {sq.relations_sql(named=True)},
v AS (SELECT *, rec_id * CAST(1000000000 AS HUGEINT) + k AS ord FROM rel WHERE confidence >= 0.5 AND length({sq.strip("subject")}) > 1 AND length({sq.strip("obj")}) > 1
  AND NOT regexp_matches(subject, '^[\\p{{Nd}}\\s\\p{{Z}}.,;:\\-/]+$') AND NOT regexp_matches(obj, '^[\\p{{Nd}}\\s\\p{{Z}}.,;:\\-/]+$'))
SELECT subject, relation, obj, arg_max(struct_pack(v := subject_type), q).v AS subject_type, arg_max(struct_pack(v := obj_type), q).v AS obj_type, max(confidence) AS confidence, count(*) AS frequency,
  round(count(*) * max(confidence), 4) AS weight, arg_max(struct_pack(v := rec_id), q).v AS source_id, arg_max(struct_pack(v := source_text), q).v AS source_text
FROM (SELECT *, row_number() OVER (PARTITION BY subject, relation, obj ORDER BY confidence, ord DESC) AS q FROM v) GROUP BY subject, relation, obj""")
def q_graph_from_text(spark, d):
    """Text to final triples in one plan: normalize entities, extract, filter, dedup."""
    rows = ner.normalized(_records(spark, d))
    found = relations.triples(rows).withColumn("triple_id", F.col("source_id") * 10000 + F.col("emit_no"))
    return triples.dedup(found).drop("ord")


@query()
def q_rule_entities(spark, d):
    rows = ner.from_rules(_texts(spark, d).drop("entities"), _entries(spark, d))
    return rows.select("rec_id", F.posexplode("entities").alias("i", "e")).select("rec_id", "i", "e.text", "e.etype")


@query()
def q_stream_articles(spark, d):
    """Articles as a file stream through extraction by rules; the edges written by the micro-batches."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    entries = _entries(spark, d)
    schema = spark.read.parquet(f"{d}/articles.parquet").schema
    q = incremental.follow_articles(spark, f"{d}/articles.parquet", schema, f"{root}/edges", f"{root}/progress", lambda rows: ner.from_rules(rows, entries))
    q.awaitTermination()
    return spark.read.parquet(f"{root}/edges").groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('day', extracted_at) AS start, relation, count(*) AS n FROM triples WHERE extracted_at IS NOT NULL GROUP BY 1, 2")
def q_windowed_counts(spark, d):
    events = table(spark, d, "triples").where("extracted_at is not null").select(F.col("extracted_at").alias("ts"), "relation")
    return incremental.windowed_counts(events).select(F.col("start"), "relation", "n")


# ---- training data -------------------------------------------------------------------------------

MOST_TOKENS = 256
_SEQ = f"""{sq.BIO},
s AS MATERIALIZED (SELECT rec_id AS seq_id, coalesce(list(token ORDER BY i) FILTER (WHERE token IS NOT NULL), []) AS tokens, coalesce(list(label ORDER BY i) FILTER (WHERE token IS NOT NULL), []) AS labels FROM t LEFT JOIN bio USING (rec_id) GROUP BY rec_id),
x AS (SELECT seq_id, unnest(labels) AS label FROM s),
ids AS (SELECT label, row_number() OVER (ORDER BY label <> 'O', label) - 1 AS label_id FROM (SELECT label FROM x UNION SELECT 'O'))"""


def _seqs(spark, d):
    """Labelled sentences as token sequences."""
    return _labelled(spark, d).select(F.col("rec_id").alias("seq_id"), F.transform("bio", lambda x: x["token"]).alias("tokens"), F.transform("bio", lambda x: x["label"]).alias("labels"))


_CHUNKS = "p AS (SELECT seq_id, tokens, labels, unnest(range(0, greatest(1, CAST(ceil(len(tokens) / 256.0) AS BIGINT)))) AS chunk_no FROM s)"


@query(f"WITH {_SEQ}, {_CHUNKS} SELECT seq_id, chunk_no, array_to_string(list_slice(tokens, chunk_no * 256 + 1, chunk_no * 256 + 256), ' ') AS tokens, array_to_string(list_slice(labels, chunk_no * 256 + 1, chunk_no * 256 + 256), ' ') AS labels FROM p")
def q_chunk(spark, d):
    parts = training.chunked(_seqs(spark, d), MOST_TOKENS)
    return parts.select("seq_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.array_join("tokens", " ").alias("tokens"), F.array_join("labels", " ").alias("labels"))


@query(
    f"WITH {_SEQ} SELECT CAST(min(len(tokens)) AS BIGINT) AS least, round(avg(len(tokens)), 6) AS mean, CAST(max(len(tokens)) AS BIGINT) AS most, round(quantile_cont(len(tokens), 0.95), 6) AS p95, "
    "round(avg(CASE WHEN len(tokens) > 256 THEN 1.0 ELSE 0.0 END), 6) AS share_over FROM s"
)
def q_len_stats(spark, d):
    return training.length_stats(_seqs(spark, d), MOST_TOKENS)


@query(f"WITH {_SEQ} SELECT label, CAST(label_id AS INTEGER) AS label_id FROM ids")
def q_label_ids(spark, d):
    return training.label_ids(_seqs(spark, d))


@query(f"WITH {_SEQ}, n AS (SELECT label, count(*) AS n FROM x GROUP BY 1) SELECT label, n, round(n / CAST((SELECT sum(n) FROM n) AS DOUBLE) * 100, 4) AS pct FROM n")
def q_label_shares(spark, d):
    rows = _seqs(spark, d).select(F.transform("labels", lambda x: F.struct(F.lit("").alias("token"), x.alias("label"))).alias("b"))
    return bio.label_counts(rows, "b")


@query(f"WITH {_SEQ}, n AS (SELECT string_split(label, '-')[-1] AS etype, count(*) AS n FROM x WHERE label <> 'O' GROUP BY 1) SELECT etype, n, round(n / CAST((SELECT sum(n) FROM n) AS DOUBLE), 6) AS share FROM n")
def q_type_shares(spark, d):
    return training.type_shares(_seqs(spark, d))


_RARE = _SEQ + ", n AS (SELECT string_split(label, '-')[-1] AS etype, count(*) AS n FROM x WHERE label <> 'O' GROUP BY 1), rare AS (SELECT etype FROM n WHERE round(n / CAST((SELECT sum(n) FROM n) AS DOUBLE), 6) < 0.05)"


@query(f"WITH {_RARE} SELECT seq_id, coalesce(list_has_any(list_transform(labels, lambda l: string_split(l, '-')[-1]), (SELECT list(etype) FROM rare)), false) AS has_rare FROM s")
def q_rare_weights(spark, d):
    seqs = _seqs(spark, d)
    return training.weighted(seqs, training.rare_types(seqs)).select("seq_id", "has_rare")


@query()
def q_weighted_resample(spark, d):
    seqs = _seqs(spark, d)
    return training.resampled(training.weighted(seqs, training.rare_types(seqs)))


@query(
    f"WITH {_SEQ}, n AS (SELECT ids.label, label_id, count(x.label) AS n FROM ids LEFT JOIN x ON x.label = ids.label GROUP BY 1, 2), "
    "w AS (SELECT *, least(greatest(sqrt((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * CAST(greatest(n, 1) AS DOUBLE))), 0.1), 10.0) AS w FROM n) "
    "SELECT label, CAST(label_id AS INTEGER) AS label_id, n, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w"
)
def q_class_weights(spark, d):
    seqs = _seqs(spark, d)
    return training.class_weights(seqs, training.label_ids(seqs))


@query(f"WITH {_SEQ}, n AS (SELECT seq_id, unnest(labels) AS label, generate_subscripts(labels, 1) AS i FROM s) SELECT seq_id, coalesce(string_agg(label_id::VARCHAR, ' ' ORDER BY i), '') AS tags FROM s LEFT JOIN n USING (seq_id) LEFT JOIN ids USING (label) GROUP BY seq_id")
def q_encode_labels(spark, d):
    seqs = _seqs(spark, d)
    return training.encoded(seqs, training.label_ids(seqs)).select("seq_id", F.array_join(F.col("ner_tags").cast("array<string>"), " ").alias("tags"))


@query(f"WITH {_SEQ}, {_CHUNKS}, n AS (SELECT count(*) AS n FROM p) SELECT 'test' AS part, CAST(floor(n * 0.05) AS BIGINT) AS n FROM n UNION ALL SELECT 'validation', CAST(floor(n * 0.10) AS BIGINT) FROM n UNION ALL SELECT 'train', n - CAST(floor(n * 0.05) AS BIGINT) - CAST(floor(n * 0.10) AS BIGINT) FROM n")
def q_split(spark, d):
    return training.split(training.chunked(_seqs(spark, d), MOST_TOKENS)).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SEQ}, n AS (SELECT seq_id, unnest(labels) AS label, unnest(tokens) AS token, generate_subscripts(labels, 1) AS i FROM s), "
    "w AS (SELECT seq_id, i, label_id, unnest(range(0, greatest(1, (length(token) + 3) // 4))) AS k FROM n JOIN ids USING (label)), "
    "z AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY i, k) AS place, CASE WHEN k = 0 THEN label_id ELSE -100 END AS tag FROM w) "
    "SELECT seq_id, trim('-100 ' || coalesce(string_agg(tag::VARCHAR, ' ' ORDER BY place) FILTER (WHERE place <= 254), '')) || ' -100' AS aligned FROM s LEFT JOIN z USING (seq_id) GROUP BY seq_id")
def q_align_subwords(spark, d):
    seqs = _seqs(spark, d)
    rows = training.encoded(seqs, training.label_ids(seqs)).withColumn("ids", training.word_ids(F.col("tokens"), lambda w: (len(w) + 3) // 4, MOST_TOKENS))
    return rows.select("seq_id", F.array_join(training.align_labels(F.col("ids"), F.col("ner_tags")).cast("array<string>"), " ").alias("aligned"))


def _entities_sql(name: str, source: str) -> str:
    """Entities of a label column; an I- after another type or O opens one too."""
    return f"""
{name}0 AS (SELECT rec_id, i, label, CASE WHEN label <> 'O' THEN substr(label, 3) END AS t, lag(CASE WHEN label <> 'O' THEN substr(label, 3) END) OVER (PARTITION BY rec_id ORDER BY i) AS pt FROM {source}),
{name}1 AS (SELECT *, sum(CASE WHEN t IS NOT NULL AND (left(label, 2) = 'B-' OR pt IS NULL OR pt <> t) THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY i) AS run FROM {name}0),
{name} AS (SELECT rec_id, run, any_value(t) AS etype, min(i) AS a, max(i) AS b FROM {name}1 WHERE t IS NOT NULL GROUP BY 1, 2)"""


_PRF = f"""{sq.BIO},
plain AS (SELECT rec_id, i, token, coalesce((SELECT CASE WHEN sp.s = k.s THEN 'B-' ELSE 'I-' END || sp.etype FROM dict sp WHERE sp.rec_id = k.rec_id AND sp.s <= k.s AND k.e <= sp.e ORDER BY sp.s LIMIT 1), 'O') AS label FROM toks k),
{_entities_sql("gold", "bio")},{_entities_sql("pred", "plain")},
gs AS (SELECT etype, count(*) AS support FROM gold GROUP BY 1), ps AS (SELECT etype, count(*) AS found FROM pred GROUP BY 1),
hs AS (SELECT gold.etype, count(*) AS tp FROM gold JOIN pred ON gold.rec_id = pred.rec_id AND gold.etype = pred.etype AND gold.a = pred.a AND gold.b = pred.b GROUP BY 1),
m AS (SELECT etype, coalesce(support, 0) AS support, coalesce(found, 0) AS found, coalesce(tp, 0) AS tp FROM gs FULL JOIN ps USING (etype) LEFT JOIN hs USING (etype)),
every AS (SELECT * FROM m UNION ALL SELECT 'micro', sum(support), sum(found), sum(tp) FROM m)"""


def _both_labels(spark, d):
    texts = _resolved(spark, d).withColumn("toks", bio.tokens("text"))
    own = spans.dictionary_spans(F.col("text"), _entries(spark, d))
    rows = materialize(texts.select("rec_id", "toks", "spans", own.alias("own")))
    labels = lambda c: F.transform(bio.spans_to_bio(F.col("toks"), F.col(c)), lambda x: x["label"])
    return rows.select(F.col("rec_id").alias("seq_id"), labels("spans").alias("labels"), labels("own").alias("predicted"))


@query(
    f"WITH {_PRF} SELECT etype, CAST(support AS BIGINT) AS support, CAST(found AS BIGINT) AS found, CAST(tp AS BIGINT) AS tp, round(CASE WHEN found > 0 THEN tp / CAST(found AS DOUBLE) ELSE 0 END, 6) AS precision, "
    "round(CASE WHEN support > 0 THEN tp / CAST(support AS DOUBLE) ELSE 0 END, 6) AS recall, round(CASE WHEN support + found > 0 THEN 2.0 * tp / (support + found) ELSE 0 END, 6) AS f1 FROM every"
)
def q_entity_prf(spark, d):
    """Labels by model and dictionary as gold, by the dictionary alone as predicted."""
    return training.scores(_both_labels(spark, d), "labels", "predicted")


@query(f"WITH {_PRF} SELECT round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM bio a JOIN plain b USING (rec_id, i)")
def q_token_accuracy(spark, d):
    return training.token_accuracy(_both_labels(spark, d), "labels", "predicted")


_LOGITS = "SELECT span_id, [coalesce(score, 0.0), length(coalesce(text, '')) / 40.0, 0.5] AS v, CASE WHEN span_id % 7 = 0 THEN -100 ELSE CAST(span_id % 3 AS INTEGER) END AS gold FROM entity_spans"


def _logits(spark, d):
    values = F.array(F.coalesce("score", F.lit(0.0)), F.length(F.coalesce("text", F.lit(""))) / 40.0, F.lit(0.5))
    gold = F.when(F.col("span_id") % 7 == 0, -100).otherwise((F.col("span_id") % 3).cast("int"))
    return table(spark, d, "entity_spans").select("span_id", values.alias("v"), gold.alias("gold"))


@query(f"WITH l AS ({_LOGITS}) SELECT span_id, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS best FROM l")
def q_argmax(spark, d):
    return _logits(spark, d).select("span_id", training.argmax(F.col("v")).cast("bigint").alias("best"))


@query(f"WITH l AS ({_LOGITS}) SELECT CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS predicted, gold, count(*) AS n FROM l WHERE gold <> -100 GROUP BY 1, 2")
def q_decoded_pairs(spark, d):
    """Predicted and gold ids without the ignored places, as the pairs a score is made of."""
    rows = _logits(spark, d).select(F.explode(training.drop_ignored(F.array(training.argmax(F.col("v"))), F.array("gold"))).alias("x"))
    return rows.groupBy(F.col("x.p").cast("int").alias("predicted"), F.col("x.g").alias("gold")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(floor((triple_id % 1000) / 100) AS BIGINT) AS epoch, round(avg(confidence), 6) AS loss FROM triples WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY 1")
def q_epoch_loss(spark, d):
    logs = table(spark, d, "triples").select((F.col("triple_id") % 1000 + 1).alias("step"), F.col("confidence").alias("loss"))
    return training.epoch_losses(logs, 100)


@query(f"WITH {_RARE}, w AS (SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(list_has_any(list_transform(labels, lambda l: string_split(l, '-')[-1]), (SELECT list(etype) FROM rare)), false)) AS r FROM s) SELECT round(r * 3.0 / (n + r * 2.0) * 100, 6) AS pct FROM w")
def q_effective_rare_share(spark, d):
    seqs = _seqs(spark, d)
    rows = training.weighted(seqs, training.rare_types(seqs)).agg(F.count(F.lit(1)).alias("n"), F.count_if("has_rare").alias("r"))
    return rows.select(F.round(training.effective_rare_pct(F.col("r"), F.col("n"), 3.0), 6).alias("pct"))
