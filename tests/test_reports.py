import csv
import json
import xml.dom.minidom

from pyspark.sql import functions as F

from loomgraph import __main__ as cli
from loomgraph.operators import reporting
from loomgraph.sources import pages, writers

ROWS = [("An", "PERSON", "LÃNH_ĐẠO", "FPT", "ORGANIZATION", 0.9), ("FPT", "ORGANIZATION", "HỢP_TÁC", "BIDV", "", 0.8), ("BIDV", "ORGANIZATION", "HỢP_TÁC", "FPT", "ORGANIZATION", 0.8), ("An", "PERSON", "X", "An", "PERSON", 1.0)]


def test_command_line(spark, tmp_path):
    with (tmp_path / "t.csv").open("w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(["subject", "subject_type", "relation", "object", "object_type", "confidence"])
        out.writerows(ROWS)
    report = cli.run(["--input", str(tmp_path / "t.csv"), "--output-dir", str(tmp_path / "out"), "--top-k", "2"], spark)
    lines = [r.line for r in report.orderBy("no").collect()]
    assert "Graph: 3 nodes, 3 unique directed edges" in lines[0] and lines[1] == "\nTop 2 by Degree:" and lines[2].startswith(" 1. FPT | type=ORGANIZATION | degree=3 | betweenness=0.5")
    raw = (tmp_path / "out" / "summary.json").read_bytes()
    summary = json.loads(raw.decode("utf-8-sig"))
    assert raw.startswith(b"\xef\xbb\xbf") and summary["graph"]["nodes"] == 3 and [n["node"] for n in summary["top_by_degree"]] == ["FPT", "BIDV"]
    part = next((tmp_path / "out" / "node_metrics.csv").glob("part-*.csv")).read_bytes()
    rows = list(csv.DictReader(part.decode("utf-8-sig").splitlines()))
    assert part.startswith(b"\xef\xbb\xbf") and list(rows[0]) == list(writers.METRIC_COLUMNS) and [r["node"] for r in rows] == ["FPT", "BIDV", "An"]
    assert cli.arguments([]).top_k == 20 and cli.arguments([]).input == "data/triples.csv"


def _graph(spark):
    nodes = spark.createDataFrame([("An", "PERSON", 1), ("FPT", "ORGANIZATION", 3), ("</script>", None, 2)], "node string, entity_type string, degree long")
    edges = spark.createDataFrame([("An", "FPT", "LÃNH_ĐẠO", 2), ("FPT", "</script>", "HỢP_TÁC", 1), ("FPT", "gone", "R", 1)], "src string, dst string, relation string, frequency long")
    return reporting.styled_nodes(nodes), reporting.styled_edges(edges)


def test_pages(spark, tmp_path):
    nodes, edges = _graph(spark)
    writers.html(nodes, edges, str(tmp_path / "g.html"))
    page = (tmp_path / "g.html").read_text(encoding="utf-8")
    body = json.loads(page.split('type="application/json">')[1].split("</script>")[0].replace("<\\/", "</"))
    assert len(body["nodes"]) == 3 and len(body["edges"]) == 2 and not body["cut"] and page.count("</script>") == 2
    small = pages.network(nodes, edges, 1)
    assert small["cut"] and "only the largest" in pages.interactive_page(small)
    for svg in (pages.network_svg(pages.network(nodes, edges)), pages.bars_svg("t", [("a<b", 3), ("c", 0)]), pages.bars_svg("t", []), pages.series_svg("t", {})):
        xml.dom.minidom.parseString(svg)
    degrees = spark.createDataFrame([(5, 1, 1), (1, 9, 2)], "degree long, nodes long, first_rank long")
    assert pages.degree_chart(degrees).count("<circle") == 2
    assert "<path d=\"M" in pages.training_chart(spark.createDataFrame([(0, 1.5), (1, 0.5)], "epoch long, loss double"))


def test_layout():
    place = pages.spring_layout(["a", "b", "c", "d"], [("a", "b"), ("c", "d"), ("x", "a")])
    far = lambda p, q: sum((x - y) ** 2 for x, y in zip(place[p], place[q], strict=True))
    assert place == pages.spring_layout(["a", "b", "c", "d"], [("a", "b"), ("c", "d")]) and far("a", "b") < far("a", "c") and pages.spring_layout([], []) == {}


def test_single_files(spark, tmp_path):
    df = spark.createDataFrame([(1, ["ế"]), (2, None)], "id long, tokens array<string>")
    writers.json_array(df.orderBy("id"), str(tmp_path / "a.json"))
    assert json.loads((tmp_path / "a.json").read_text(encoding="utf-8")) == [{"id": 1, "tokens": ["ế"]}, {"id": 2, "tokens": None}]
    writers.json_array(df.limit(0), str(tmp_path / "a.json"))
    assert json.loads((tmp_path / "a.json").read_text(encoding="utf-8")) == []
    labels = spark.createDataFrame([("O", 0), ("B-X", 1)], "label string, label_id int")
    writers.model_files(spark, str(tmp_path / "m"), labels, {"seed": 42}, {"f1": 0.5})
    assert json.loads((tmp_path / "m" / "id2label.json").read_text()) == {"0": "O", "1": "B-X"} and json.loads((tmp_path / "m" / "test_metrics.json").read_text()) == {"f1": 0.5}
    try:
        with writers.shared_text(spark, str(tmp_path / "b.txt")) as put:
            put("x")
            raise KeyError
    except KeyError:
        pass
    assert not (tmp_path / "b.txt").exists()


def test_progress(spark):
    row = reporting.progress(spark.range(50).withColumn("x", F.lit(1)), 200, 10).first()
    assert (row.rows, row.pct, row.rows_per_s, row.seconds_left) == (50, 25.0, 5.0, 30.0)
