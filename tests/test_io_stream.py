import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import ner
from loomgraph.sources import readers, writers
from loomgraph.streaming import incremental

TRIPLE = {"subject": "A", "subject_type": "T", "relation": "R", "obj": "B\nC", "confidence": 0.5}


def test_triples(spark, tmp_path):
    for name, body in (("list.json", [TRIPLE]), ("object.json", {"metadata": {}, "triples": [TRIPLE]})):
        (tmp_path / name).write_text("\ufeff" + json.dumps(body), encoding="utf-8")
        assert readers.triples(spark, str(tmp_path / name)).first().obj == "B\nC"
    (tmp_path / "t.csv").write_text('\ufeffsubject,relation,object\nA,R,"x ""y""\nz"\n', encoding="utf-8")
    row = readers.triples(spark, str(tmp_path / "t.csv")).first()
    assert (row.subject, row.object) == ("A", 'x "y"\nz')
    with pytest.raises(ValueError):
        readers.triples(spark, "x.xml")


def test_articles(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffid,title,content\n1,"T, t","a\nb"\nx,,\n', encoding="utf-8")
    rows = readers.articles_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [(1, "T, t", "a\nb"), (None, None, None)]


def test_json_lines_of_triples(spark):
    lines = [(1, '{"obj":"B","subject":"A","confidence":0.5,"source_id":7}'), (2, ' {"object":"B","object_type":"T","subject":"A"} '), (3, '{"subject":"A","obj'), (4, None), (5, "")]
    got = readers.json_triple_lines(spark.createDataFrame(lines, "triple_id long, line string")).orderBy("triple_id").collect()
    assert [(r.triple_id, r.subject, r.obj, r.obj_type, r.source_id) for r in got] == [(1, "A", "B", None, 7), (2, "A", "B", "T", None)]


def test_conll_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, [("a", "B-X"), ("b c", "O")]), (2, []), (3, [("d", "O")])], "i long, b array<struct<token:string,label:string>>")
    assert writers.conll(df.coalesce(1), "b", str(tmp_path / "c"), order="i") == 2
    got = readers.conll(spark, str(tmp_path / "c")).collect()
    assert sorted((r.tokens, r.labels) for r in got) == [(["a", "b c"], ["B-X", "O"]), (["d"], ["O"])]
    (tmp_path / "odd.txt").write_text("x y O\n\t \nz\nw B-A\n", encoding="utf-8")
    assert sorted((r.tokens, r.labels) for r in readers.conll(spark, str(tmp_path / "odd.txt")).collect()) == [(["w"], ["B-A"]), (["x"], ["O"])]


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([("A&B", "T", 1), ("C", None, 1)], "node string, entity_type string, degree int")
    edges = spark.createDataFrame([("A&B", "C", "R|S", 0.5, 2, 1.0)], "src string, dst string, relation string, confidence double, frequency long, weight double")
    import xml.etree.ElementTree as ET

    for name in ("g.graphml", "g.gexf"):
        writers.graph_xml(nodes, edges, str(tmp_path / name))
        ET.parse(tmp_path / name)
    writers.document(spark.createDataFrame([("m", 1)], "model string, total_triples long"), edges, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text())["metadata"]["total_triples"] == 1
    writers.html(nodes, edges, str(tmp_path / "g.html"))
    assert writers.listing(spark, str(tmp_path)).count() == 4


def test_stream_equals_batch(spark, tmp_path):
    text = "BIDV và VPBank ký kết tại Hà Nội."
    articles = spark.createDataFrame([(1, text, None), (2, None, text), (3, None, None)], "id long, title string, content string")
    articles.write.parquet(str(tmp_path / "in"))
    known = ner.ENTITIES
    provide = lambda rows: rows.withColumn("entities", F.array(*[F.struct(F.lit(t).alias("text"), F.lit("ORGANIZATION").alias("etype"), F.lit(1.0).alias("score")) for t in ("BIDV", "VPBank")]).cast(known))
    q = incremental.follow_articles(spark, str(tmp_path / "in"), "id long, title string, content string", str(tmp_path / "out"), str(tmp_path / "cp"), provide)
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = incremental.new_edges(incremental.article_triples(articles, provide))
    assert sorted(map(tuple, got.select("src", "dst", "source_id").collect())) == sorted(map(tuple, want.select("src", "dst", "source_id").collect())) and got.count() == 4
    assert incremental.running_degrees(got).count() == 2


def test_model_provider(spark):
    rows = spark.createDataFrame([(1, "FPT"), (2, None)], "row_id long, text string")
    load = lambda: lambda texts: [[{"text": t, "etype": "ORGANIZATION", "score": 0.9}] if t else [] for t in texts]
    got = {r.row_id: r.entities for r in ner.from_model(rows, load).collect()}
    assert got[1][0].text == "FPT" and got[2] == []


def test_conll_line_ends(spark, tmp_path):
    body = "An\tB-PERSON\nBình\tI-PERSON\n\nở O\n \nHuế x B-LOCATION\nbare\n"
    want = [(["An", "Bình"], ["B-PERSON", "I-PERSON"]), (["Huế"], ["B-LOCATION"]), (["ở"], ["O"])]
    for name, text in (("lf", body), ("crlf", body.replace("\n", "\r\n"))):
        (tmp_path / name).write_bytes(text.encode())
        rows = readers.conll(spark, str(tmp_path / name)).collect()
        assert sorted((r.tokens, r.labels) for r in rows) == want and len({r.seq_id for r in rows}) == 3


def test_new_articles_are_normalized(spark):
    df = spark.createDataFrame([(1, "Giá\xa0vàng\u200b \u201ctăng\u201d", None)], "id long, title string, content string")
    seen = []

    def provide(rows):
        seen.extend(r.text for r in rows.collect())
        return rows.withColumn("entities", F.array().cast(ner.ENTITIES))

    assert incremental.article_triples(df, provide).count() == 0
    assert seen == ['Giá vàng "tăng"']


def test_failing_model_batches_are_reported(spark):
    def load():
        def infer(texts):
            if "bad" in texts:
                raise ValueError("no")
            return [[{"text": t, "etype": "X", "score": 1}] for t in texts]

        return infer

    df = spark.createDataFrame([("a",), ("bad",)], "text string").repartition(1)
    got = {r.text: (len(r.entities), r.error) for r in ner.from_model(df, load, batch=1).collect()}
    assert got == {"a": (1, None), "bad": (0, "ValueError('no')")}
