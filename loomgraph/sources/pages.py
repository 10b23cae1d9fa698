"""Pages and charts of bounded reports: layout of a top-K subgraph, an interactive page, and charts as SVG.

All of them draw what a report holds (top K nodes, counts by type, a series), never
a whole graph; the DataFrames are cut to ``limit`` rows by the caller's order and
the page says so where rows are left out.
"""

from __future__ import annotations

import json
import math
from html import escape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.writers import shared_text

WIDTH, HEIGHT, MARGIN = 960, 640, 48


def spring_layout(names: list[str], pairs: list[tuple[str, str]], rounds: int = 60, seed: int = 42) -> dict[str, tuple[float, float]]:
    """Places in [-1, 1] by attraction along edges and repulsion between all nodes, cooling linearly; the same for the same seed."""
    n = len(names)
    if n == 0:
        return {}
    at = {name: i for i, name in enumerate(names)}
    links = np.zeros((n, n))
    for a, b in pairs:
        if a in at and b in at and a != b:
            links[at[a], at[b]] = links[at[b], at[a]] = 1
    pos = np.random.default_rng(seed).random((n, 2))
    ideal = math.sqrt(1 / n)
    for k in range(rounds):
        gap = pos[:, None, :] - pos[None, :, :]
        far = np.maximum(np.linalg.norm(gap, axis=2), 0.01)
        force = (gap * (ideal**2 / far**2 - links * far / ideal)[:, :, None]).sum(axis=1)
        size = np.maximum(np.linalg.norm(force, axis=1), 0.01)
        pos += force / size[:, None] * np.minimum(size, 0.1 * (1 - k / rounds))[:, None]
    pos -= pos.mean(axis=0)
    pos /= max(np.abs(pos).max(), 1e-9)
    return {name: (float(x), float(y)) for name, (x, y) in zip(names, pos, strict=True)}


def _svg(title: str, body: list[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" font-family="sans-serif" font-size="12"><rect width="100%" height="100%" fill="#fff"/>'
    return "\n".join([head, f'<text x="{WIDTH / 2}" y="24" text-anchor="middle" font-size="16">{escape(title)}</text>', *body, "</svg>\n"])


def _scale(values: list[float], a: float, b: float, log: bool = False):
    f = (lambda v: math.log10(max(v, 1e-12))) if log else float
    low, high = (f(min(values)), f(max(values))) if values else (0.0, 1.0)
    return lambda v: a + (b - a) * ((f(v) - low) / (high - low) if high > low else 0.5)


def series_svg(title: str, lines: dict[str, list[tuple[float, float]]], log: bool = False, dots: bool = False) -> str:
    """Lines, or dots, of one or more series on common axes; ``log`` for both axes."""
    points = [p for line in lines.values() for p in line]
    x, y = _scale([p[0] for p in points], MARGIN, WIDTH - MARGIN, log), _scale([p[1] for p in points], HEIGHT - MARGIN, MARGIN, log)
    body = [f'<path d="M{MARGIN} {MARGIN}V{HEIGHT - MARGIN}H{WIDTH - MARGIN}" fill="none" stroke="#999"/>']
    for k, (name, line) in enumerate(lines.items()):
        colour = ("#4E79A7", "#F28E2B", "#59A14F", "#E15759")[k % 4]
        if dots:
            body += [f'<circle cx="{x(a):.1f}" cy="{y(b):.1f}" r="3" fill="{colour}"/>' for a, b in line]
        elif line:
            body.append(f'<path d="M{" L".join(f"{x(a):.1f} {y(b):.1f}" for a, b in line)}" fill="none" stroke="{colour}" stroke-width="2"/>')
        body.append(f'<text x="{WIDTH - MARGIN}" y="{MARGIN + 16 * k}" text-anchor="end" fill="{colour}">{escape(name)}</text>')
    if points:
        for v, place in ((min(p[0] for p in points), MARGIN), (max(p[0] for p in points), WIDTH - MARGIN)):
            body.append(f'<text x="{place}" y="{HEIGHT - MARGIN + 18}" text-anchor="middle">{v:g}</text>')
        for v, place in ((min(p[1] for p in points), HEIGHT - MARGIN), (max(p[1] for p in points), MARGIN)):
            body.append(f'<text x="{MARGIN - 6}" y="{place}" text-anchor="end">{v:g}</text>')
    return _svg(title, body)


def bars_svg(title: str, counts: list[tuple[str, float]], colours: dict[str, str] | None = None) -> str:
    """Horizontal bars with their shares of the whole, in the given order."""
    total, most = sum(v for _, v in counts) or 1, max((v for _, v in counts), default=1) or 1
    high = (HEIGHT - 2 * MARGIN) / max(1, len(counts))
    body = []
    for k, (name, v) in enumerate(counts):
        y = MARGIN + k * high
        body.append(f'<rect x="240" y="{y:.1f}" width="{(WIDTH - 240 - 2 * MARGIN) * v / most:.1f}" height="{high * 0.8:.1f}" fill="{(colours or {}).get(name, "#4E79A7")}"/>')
        body.append(f'<text x="232" y="{y + high * 0.5:.1f}" text-anchor="end">{escape(str(name))}</text><text x="{WIDTH - MARGIN}" y="{y + high * 0.5:.1f}" text-anchor="end">{v:g} ({100 * v / total:.1f}%)</text>')
    return _svg(title, body)


def degree_chart(degrees: DataFrame) -> str:
    """Degree against rank on logarithmic axes; one point a distinct degree."""
    points = [(r.first_rank, r.degree) for r in degrees.orderBy("first_rank").collect()]  # a row a distinct degree
    return series_svg("Degree by rank", {"degree": points}, log=True, dots=True)


def training_chart(losses: DataFrame) -> str:
    """Loss of each epoch."""
    return series_svg("Loss by epoch", {"training loss": [(r.epoch, r.loss) for r in losses.orderBy("epoch").collect()]})


def _cut(df: DataFrame, limit: int) -> tuple[list[dict], bool]:
    rows = [r.asDict() for r in df.limit(limit + 1).collect()]
    return rows[:limit], len(rows) > limit


def network(nodes: DataFrame, edges: DataFrame, limit: int = 200) -> dict:
    """Nodes, edges and layout of a report: ``nodes`` and ``edges`` as styled, the largest ones first; ``cut`` tells that more exist."""
    ns, more = _cut(nodes.orderBy(F.desc("degree"), "node"), limit)
    names = [n["node"] for n in ns]
    chosen = edges.join(F.broadcast(nodes.sparkSession.createDataFrame([(n,) for n in names], "src string")), "src", "left_semi")
    chosen = chosen.join(F.broadcast(nodes.sparkSession.createDataFrame([(n,) for n in names], "dst string")), "dst", "left_semi")
    es, more_edges = _cut(chosen.orderBy(F.desc("frequency"), "src", "dst", "relation"), 10 * limit)
    places = spring_layout(names, [(e["src"], e["dst"]) for e in es])
    for n in ns:
        n["x"], n["y"] = places[n["node"]]
    return {"nodes": ns, "edges": es, "cut": more or more_edges}


def network_svg(graph: dict, title: str = "Graph") -> str:
    x, y = (lambda v: WIDTH / 2 + v * (WIDTH / 2 - MARGIN)), (lambda v: HEIGHT / 2 + v * (HEIGHT / 2 - MARGIN))
    at = {n["node"]: (x(n["x"]), y(n["y"])) for n in graph["nodes"]}
    body = [
        f'<line x1="{at[e["src"]][0]:.1f}" y1="{at[e["src"]][1]:.1f}" x2="{at[e["dst"]][0]:.1f}" y2="{at[e["dst"]][1]:.1f}" stroke="{e["colour"]}" stroke-width="{e["width"]}"><title>{escape(str(e["relation"]))}</title></line>'
        for e in graph["edges"]
    ]
    for n in graph["nodes"]:
        a, b = at[n["node"]]
        body.append(f'<circle cx="{a:.1f}" cy="{b:.1f}" r="{n["size"] / 3:.1f}" fill="{n["colour"]}"><title>{escape(str(n["entity_type"]))}, degree {n["degree"]}</title></circle><text x="{a:.1f}" y="{b - n["size"] / 3 - 2:.1f}" text-anchor="middle">{escape(n["node"])}</text>')
    return _svg(title, body)


_SCRIPT = """
const g = JSON.parse(document.getElementById('graph').textContent), c = document.querySelector('canvas'), t = c.getContext('2d'), at = {};
let scale = 1, dx = 0, dy = 0, held = null, from = null;
g.nodes.forEach(n => { at[n.node] = n; });
const fit = () => { c.width = innerWidth; c.height = innerHeight - 40; draw(); };
const X = n => c.width / 2 + dx + n.x * scale * c.width * 0.45, Y = n => c.height / 2 + dy + n.y * scale * c.height * 0.45;
function draw() {
  t.clearRect(0, 0, c.width, c.height); t.textAlign = 'center'; t.font = '12px sans-serif';
  g.edges.forEach(e => { const a = at[e.src], b = at[e.dst]; t.strokeStyle = e.colour; t.lineWidth = e.width; t.beginPath(); t.moveTo(X(a), Y(a)); t.lineTo(X(b), Y(b)); t.stroke();
    if (scale > 1.5) { t.fillStyle = '#555'; t.fillText(e.relation, (X(a) + X(b)) / 2, (Y(a) + Y(b)) / 2); } });
  g.nodes.forEach(n => { t.fillStyle = n.colour; t.beginPath(); t.arc(X(n), Y(n), n.size / 2.5, 0, 7); t.fill(); t.fillStyle = '#111'; t.fillText(n.node, X(n), Y(n) - n.size / 2.5 - 3); });
}
const near = e => g.nodes.find(n => Math.hypot(X(n) - e.offsetX, Y(n) - e.offsetY) < n.size / 2.5);
c.onmousedown = e => { held = near(e) || null; from = [e.offsetX, e.offsetY]; };
c.onmouseup = () => { held = from = null; };
c.onmousemove = e => {
  const n = near(e); document.getElementById('about').textContent = n ? `${n.node}: ${n.entity_type}, degree ${n.degree}` : '';
  if (!from) return;
  if (held) { held.x = (e.offsetX - c.width / 2 - dx) / (scale * c.width * 0.45); held.y = (e.offsetY - c.height / 2 - dy) / (scale * c.height * 0.45); }
  else { dx += e.offsetX - from[0]; dy += e.offsetY - from[1]; from = [e.offsetX, e.offsetY]; }
  draw();
};
c.onwheel = e => { scale *= e.deltaY < 0 ? 1.1 : 0.9; draw(); e.preventDefault(); };
onresize = fit; fit();
"""


def interactive_page(graph: dict, title: str = "Graph") -> str:
    """A page without outside parts: nodes can be dragged, the view moved and zoomed, details are shown on pointing."""
    body = json.dumps(graph, ensure_ascii=False).replace("</", "<\\/")
    note = " (only the largest nodes and most frequent edges are drawn)" if graph["cut"] else ""
    return (
        f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><style>body{{margin:0;font-family:sans-serif}}p{{margin:8px}}</style><p><b>{escape(title)}</b>{note} <span id="about"></span></p><canvas></canvas>'
        f'<script id="graph" type="application/json">{body}</script><script>{_SCRIPT}</script>\n'
    )


def save(spark, text: str, path: str) -> None:
    with shared_text(spark, path) as put:
        put(text)
