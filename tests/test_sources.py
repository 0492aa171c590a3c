import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from scholaspark import cli
from scholaspark.operators import retrieval as R
from scholaspark.plans import pipeline
from scholaspark.sources import files as S
from scholaspark.streaming import ingest

PAPER = {"doc_id": "p1", "title": "Mills", "full_text": "The old Mill stands at the River. Anna Smith wrote about the Mill and the River for a long time, and many others did so too in the years that followed her work. The Mill uses Water.", "authors": ["Anna"], "sections": [{"heading": "H", "text": "T"}], "odd": 1}


@pytest.fixture
def papers(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(PAPER, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"title": "Rivers", "sections": ["only text"], "full_text": "The River runs. " * 30}))
    (tmp_path / "c.json").write_text("not json {")
    return str(tmp_path)


def test_papers(spark, papers):
    got = {r.doc_id: r for r in S.read_papers(spark, papers).collect()}
    assert set(got) == {"p1", "b"} and got["p1"].sections[0].heading == "H" and got["b"].sections[0].text == "only text" and got["b"].authors is None
    assert {r.doc_id: r.text[:8] for r in S.read_documents(spark, papers).collect()} == {"p1": "The old ", "b": "The Rive"}


def test_texts(spark, tmp_path):
    (tmp_path / "2301.00001.txt").write_text("\n  A Title\nAnn Lee, Bo Li\n\nAbstract\nShort.\n1 Introduction\nText\n")
    assert [(r.doc_id, r.title) for r in S.read_documents(spark, str(tmp_path)).collect()] == [("2301.00001", "A Title")]
    S.preprocess_folder(spark, str(tmp_path), str(tmp_path / "out"))
    row = spark.read.json(str(tmp_path / "out")).first()
    assert (row.abstract, row.year, row.authors) == ("Short.", 2023, ["Ann Lee", "Bo Li"])
    (tmp_path / "none").mkdir()
    assert S.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_checkpoint(spark, tmp_path):
    lines = [{"chunk_id": "c1", "entities": [{"name": "A", "entity_type": "T", "description": ""}], "relations": []}, {"chunk_id": "c2", "status": "failed"}]
    path = tmp_path / "cp.jsonl"
    path.write_text("\n".join([json.dumps(x) for x in lines] + ["{broken", ""]))
    got = {r.chunk_id: r for r in S.read_checkpoint(spark, str(path)).collect()}
    assert set(got) == {"c1", "c2"} and got["c1"].status == "ok" and got["c2"].entities == [] and got["c2"].status == "failed"
    chunks = spark.createDataFrame([("c1",), ("c9",)], "chunk_id string")
    assert [r.chunk_id for r in S.not_extracted(chunks, S.read_checkpoint(spark, str(path))).collect()] == ["c9"]
    S.append_checkpoint(S.read_checkpoint(spark, str(path)), str(tmp_path / "again"))
    assert S.read_checkpoint(spark, str(tmp_path / "again")).count() == 2


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([('a<"&', "A & <b>", "T", "x\ny"), ("b", "B", "T", None), ("c", "", "T", "")], S.NODE)
    edges = spark.createDataFrame([('a<"&', "b", "r", None, 3, ["c1", 'c"2']), ("b", "b", "s", "d", 1, [])], S.EDGE)
    S.write_graphml(nodes, edges, str(tmp_path / "g"))
    whole = "\n".join(p.read_text() for p in sorted((tmp_path / "g").glob("part-*")))
    (tmp_path / "one.graphml").write_text(whole)
    import xml.etree.ElementTree as ET

    assert len(ET.fromstring(whole).find("{*}graph")) == 5
    n, e = S.read_graphml(spark, str(tmp_path / "one.graphml"))
    assert {tuple(r) for r in n.collect()} == {tuple(r) for r in nodes.collect()}
    assert sorted(map(str, e.collect())) == sorted(map(str, edges.collect()))


def test_communities_and_questions(spark, tmp_path):
    rows = spark.createDataFrame([(0, ["a"], "s", 0, 1)], S.COMMUNITY)
    S.write_communities(rows, str(tmp_path / "c"))
    assert S.read_communities(spark, str(tmp_path / "c")).collect() == rows.collect()
    (tmp_path / "side.json").write_text(json.dumps({"community_count": 1, "communities": [{"community_id": 3, "nodes": ["x", "y"], "level": 1}]}, indent=2))
    assert tuple(S.read_communities(spark, str(tmp_path / "side.json")).first()) == (3, ["x", "y"], "", 1, 2)
    (tmp_path / "q.json").write_text(json.dumps([{"question": "A?"}, {"question": "B?", "relevant_doc_ids": ["d"]}], indent=1))
    assert [(r.question_id, r.question) for r in S.read_questions(spark, str(tmp_path / "q.json")).collect()] == [(1, "A?"), (2, "B?")]
    (tmp_path / "bad.json").write_text('[{"question": " "}]')
    with pytest.raises(ValueError):
        S.read_questions(spark, str(tmp_path / "bad.json"))


def test_command_line(spark, papers, tmp_path):
    run = lambda *args: cli.main(["--folder", str(tmp_path / "w"), *args], spark)
    assert run("index", papers) == 2 and run("index", papers) == 2
    run("extract")
    run("build-graph")
    assert "Mill" in run("query", "Who wrote about the Mill?")
    (tmp_path / "q.json").write_text(json.dumps([{"question": "What does the Mill use?", "reference_answer": "The Mill uses Water.", "relevant_doc_ids": ["p1"]}]))
    assert run("preflight", str(tmp_path / "q.json"))[0] == "questions: 1"
    text = run("benchmark", str(tmp_path / "q.json"), str(tmp_path / "r"), "--mode", "vector", "--mode", "local", "--top-k", "1")
    assert "|rag|1|" in text and "|graphrag_local|1|" in text
    assert spark.read.parquet(str(tmp_path / "r" / "records")).where("pipeline = 'rag'").first().mrr == 1.0
    assert [r.doc_id for r in run("search-title", papers, "mill")] == ["p1"]
    review = (tmp_path / "r" / "review.md").read_text()
    assert review.startswith("# Benchmark Human Review") and review.count("### ") == 2 and "p1__chunk_0" in review and (tmp_path / "r" / "report.md").read_text().startswith("# Benchmark Report")
    run("graphml", str(tmp_path / "g.graphml"))
    graph = ElementTree.parse(tmp_path / "g.graphml").getroot()
    assert [e.tag.rsplit("}", 1)[-1] for e in graph][-1] == "graph" and len(graph[-1]) > 2 and not (tmp_path / "g.graphml.parts").exists()
    n, e = S.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert n.count() == spark.read.parquet(str(tmp_path / "w" / "graph" / "nodes")).count() and e.count() > 0


def test_models_through_the_pipeline(spark, papers, tmp_path):
    calls = []

    def embed(text):
        return F.array(F.length(F.coalesce(text, F.lit(""))).cast("float"), F.lit(1.0).cast("float"))

    def generate(prompts):
        return [None if "second" in p else f"Said of {len(prompts)}" for p in prompts]

    def judge(prompts):
        return [json.dumps({"score": 0.5, "rationale": "why not"}) for _ in prompts]

    models = pipeline.Models(embed=embed, generate=generate, judge=judge, summarise=lambda ps: [f"Summary {'Entity: ' in p}" for p in ps], names={"llm_model": "told"})
    w = pipeline.Workspace(spark, str(tmp_path / "m"), models)
    w.index(papers)
    assert {len(r.embedding) for r in w.read("vectors").collect()} == {2}
    w.extract()
    w.build_graph()
    assert {r.summary for r in w.read("communities").collect()} == {"Summary True"}
    asked = spark.createDataFrame([(1, "the first"), (2, "the second")], "query_id long, question string")
    got = {r.query_id: r.answer for r in w.answer(asked).collect()}
    assert got[1].startswith("Said of") and got[2] == R.NO_ANSWER
    shown = w.results(w.search(asked.where("query_id = 1"), index=w.index_vectors())).collect()
    assert shown and all(r.text and r.metadata["doc_id"] for r in shown)
    questions = spark.createDataFrame([(7, "the first", "ref", ["p1"], "local")], "question_id long, question string, reference_answer string, relevant_doc_ids array<string>, question_scope string")
    r = w.benchmark(questions, ("vector", "graph_only"), 2, "run", "now").orderBy("record_id").collect()
    assert [x.pipeline for x in r] == ["rag", "graphrag_graph_only"] and r[0].faithfulness == 0.5 and r[0].directness_rationale == "why not" and r[0].llm_model == "told" and r[0].run_id == "run"
    payload = json.loads(r[0].retrieved_chunk_payload)
    assert [x["rank"] for x in payload] == list(range(1, len(payload) + 1)) and payload[0]["text"] and r[0].estimated_context_tokens > 0 and r[1].retrieved_chunk_ids == "[]"


def test_streams(spark, tmp_path):
    rows = [("a", "T", "word " * 50, "2031-01-01 00:00:00"), ("a", "T", "word " * 50, "2031-01-01 01:00:00"), ("b", None, None, "2031-01-01 02:00:00")]
    base = spark.createDataFrame(rows, "doc_id string, title string, full_text string, at string")
    none = F.lit(None)
    base = base.select("doc_id", "title", "full_text", F.to_timestamp("at").alias("ingested_at"), none.cast("string").alias("abstract"), F.array().cast("array<string>").alias("authors"), F.array().cast("array<string>").alias("categories"), none.cast("int").alias("year"), none.cast("array<struct<heading:string,text:string>>").alias("sections"), none.cast("string").alias("source_file"))
    base.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.once(ingest.papers(spark, str(tmp_path / "in"), base.schema))
    for _ in range(2):
        q = ingest.chunk_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), size=20, overlap=5)
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("chunk_id").distinct().count() > 1 and {r.doc_id for r in got.collect()} == {"a"}


def test_record_windows(spark, tmp_path):
    rows = [("rag", "I cannot answer", 1.0, "2031-01-01 00:10:00"), ("rag", "ok", None, "2031-01-01 00:20:00"), ("rag", "ok", 3.0, "2031-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "pipeline string, answer string, latency_s double, at string").withColumn("loaded_at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ingest.record_windows(stream).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("windows").orderBy("window").collect()
    assert [(r.n_rows, r.latency_s, r.fallbacks) for r in got] == [(2, 0.5, 1), (1, 3.0, 0)]
