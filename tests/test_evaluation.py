import pytest
from pyspark.sql import functions as F

from scholaspark.operators import benchmark as B
from scholaspark.operators import communities as CO
from scholaspark.operators import metrics as M
from scholaspark.operators import retrieval as R

IDS = "a array<string>, b array<string>"


@pytest.mark.parametrize(
    ("got", "relevant", "want"),
    [(["x", "y", "z"], ["y", "q"], (0.5, 0.5, 0.5)), (["x"], None, (0.0, 0.0, 0.0)), (None, ["x"], (0.0, 0.0, 0.0)), ([], [], (0.0, 0.0, 0.0)), (["y", "y"], ["y", "y"], (1.0, 2.0, 1.0)), (["a", "b", "c"], ["c"], (0.0, 0.0, 1 / 3))],
)
def test_ranking_metrics(spark, got, relevant, want):
    df = spark.createDataFrame([(got, relevant)], IDS)
    row = df.select(M.precision_at_k(F.col("a"), F.col("b"), 2), M.recall_at_k(F.col("a"), F.col("b"), 2), M.reciprocal_rank(F.col("a"), F.col("b"))).first()
    assert tuple(row) == pytest.approx(want)


def test_as_documents(spark):
    df = spark.createDataFrame([(["d__chunk_1", "e__chunk_0", "d__chunk_2", "f"],)], "a array<string>")
    assert df.select(M.as_documents(F.col("a")).alias("x")).first().x == ["d", "e", "f"]


@pytest.mark.parametrize(("a", "b", "want"), [("the cats sat", "the cat sat", (1.0, 1.0)), ("b a", "a b", (1.0, 0.5)), ("x", "y", (0.0, 0.0)), ("", "y", (0.0, 0.0)), (None, None, (0.0, 0.0)), ("running fast now", "he runs fast", (2 / 3, 2 / 3))])
def test_rouge(a, b, want):
    assert M.rouge(a, b) == pytest.approx(want)


@pytest.mark.parametrize(("raw", "want"), [('{"score": 0.8, "rationale": " ok "}', (0.8, "ok")), ('noise {"score": "7"} x', (1.0, "")), ("about 0.35 I think", (0.35, "")), ("none", (0.0, "")), (None, (0.0, "")), ("{bad 0.5", (0.5, ""))])
def test_judge_replies(spark, raw, want):
    row = spark.createDataFrame([(raw,)], "r string").select(M.judge_reply(F.col("r")).alias("x")).first().x
    assert (round(row.score, 6), row.rationale) == want


RECORD = "record_id long, question string, pipeline string, question_scope string, search_mode string, answer string, top_k int, latency_s double, context_char_count int, precision_5 double, recall_5 double, mrr double, rouge1 double, rougel double, faithfulness double, comprehensiveness double, diversity double, directness double, empowerment double, relevant_doc_count int, retrieved_count int, relevant_hits_at_k int, has_relevant_hit_at_k boolean, retrieved_chunk_ids string"


def records(spark):
    row = lambda i, q, p, a, r, f, h: (i, q, p, " Global ", "m", a, 0, 1.0 * i, 5, 0.0, None, 0.0, r, 0.1, f, None, 2.0, -1.0, 0.5, 1, 2, h, None, '["x__chunk_1", "y"]')
    return spark.createDataFrame([row(1, "q", "rag", "I cannot answer this", 0.2, 0.9, 0), row(2, "q ", "graph", " ", 0.8, 0.1, 1), row(3, "r", "rag", None, None, None, None), row(4, "r", "graph", "fine", 0.0, 0.6, 1)], RECORD)


def test_aggregates(spark):
    got = {r.pipeline: r for r in B.aggregates(records(spark), "pipeline").collect()}
    assert got["rag"].rouge1 == pytest.approx(0.1) and got["rag"].fallback_rate == 0.5 and got["rag"].empty_rate == 0.5 and got["graph"].empty_rate == 0.5 and got["graph"].n_rows == 2
    assert {r.tier: (r.available, r.active) for r in B.tiers(records(spark)).collect()} == {"judges": (True, "faithfulness, diversity, empowerment"), "efficiency": (True, "latency_s, context_char_count"), "retrieval": (False, "")}
    assert {(r.example, r.record_id) for r in B.extremes(records(spark)).collect()} == {("best", 2), ("worst", 3)}
    assert {r.what: r.pipeline for r in B.leaders(B.aggregates(records(spark), "pipeline")).collect()} == {"highest_fallback": "rag", "lowest_latency": "rag", "largest_context": "rag", "best_rouge1": "graph", "best_faithfulness": "rag"}
    assert [tuple(r) for r in B.head_to_head(records(spark), "rouge1").collect()] == [("graph", 1, 0, 1)]
    assert B.extremes(records(spark).limit(0)).count() == 0 and B.aggregates(records(spark).limit(0), "pipeline").count() == 0


def test_validated_and_review(spark):
    got = {r.record_id: r for r in records(spark).withColumns(M.validated()).collect()}
    assert (got[1].diversity, got[1].directness, got[1].recall_5, got[1].top_k, got[1].question_scope, got[2].has_relevant_hit_at_k, got[3].relevant_hits_at_k) == (1.0, 0.0, 0.0, 1, "global", True, 0)
    review = {r.pipeline + r.question: r for r in B.review(records(spark)).collect()}
    assert review["ragq"].top_k_chunks == "1. x__chunk_1\n2. y" and review["graphq "].judge_validation_notes.startswith("Potential") and review["ragr"].judge_validation_notes.startswith("Low")


def test_report(spark):
    text = B.report(records(spark), "0123456789", "q.json", "2031-01-01")
    assert "# Benchmark Report: Run 01234567" in text and "|graph|2|0.4000|" in text and "Look into `rag`: 50.0%" in text and "Fill in" in text
    assert "No results" in B.report(records(spark).limit(0), "x", "q", "t")


def test_questions_and_preflight(spark):
    raw = spark.createDataFrame([(2, " What? ", None, [" a ", "", None], "GLOBAL"), (1, "what?", "x", None, "odd"), (3, " ", "x", [], None), (4, None, None, None, None)], "question_id long, question string, reference_answer string, relevant_doc_ids array<string>, question_scope string")
    rows = B.questions_of(raw).collect()
    assert [(r.question_id, r.question, r.question_scope, r.relevant_doc_ids) for r in rows] == [(1, "what?", "local", [])]
    with pytest.raises(RuntimeError, match="vectors: missing"):
        B.preflight(raw, None, raw, None)
    assert len(B.preflight(raw, raw, raw, None, ("local",))) == 4


def test_search_modes(spark):
    nodes = spark.createDataFrame([("mill", "Mill", "T", ""), ("river", "River", "T", ""), ("stone", "Stone", "T", "")], "node_id string, label string, entity_type string, description string")
    edges = spark.createDataFrame([("mill", "river", "stands_at"), ("river", "stone", "has")], "src string, dst string, relation_type string")
    texts = spark.createDataFrame([("c1", "The mill is old. It stands at the river."), ("c2", "Salt and pepper."), ("c3", None)], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "Where does the mill stand?"), (2, None)], "query_id long, question string")
    by_chunk = spark.createDataFrame([("c1", "mill")], "chunk_id string, node_id string")
    vectors = R.embedded(texts, "chunk_id", "text", "chunk_id")
    local = R.local_search(asked, vectors, by_chunk, nodes, edges, top_k=1)
    assert local["chunks"].where("query_id = 1").first().chunk_id == "c1"
    found = {r.query_id: r.context for r in R.contexts(asked, texts, local).collect()}
    assert found[1] == "The mill is old. It stands at the river.\n\nMill --[stands_at]--> River"
    answers = {r.query_id: r.answer for r in R.extractive_answers(R.contexts(asked.where("query_id = 1"), texts, local)).collect()}
    assert answers == {1: "The mill is old."}
    assert R.extractive_answers(spark.createDataFrame([(1, "q", "")], "query_id int, question string, context string")).first().answer.startswith("There is not enough context")
    only = R.graph_only_search(spark.createDataFrame([(1, "the river")], "query_id long, question string"), nodes, edges, top_k=1)["context"].collect()
    assert [r.line for r in only] == ["River --[has]--> Stone"]
    communities = spark.createDataFrame([(0, "mill and river"), (1, " "), (2, "salt")], "community_id int, summary string")
    assert [r.community_id for r in R.global_search(spark.createDataFrame([(1, "salt")], "query_id long, question string"), communities, 1)["summaries"].collect()] == [2]
    hybrid = R.hybrid_search(asked.where("query_id = 1"), vectors, by_chunk, nodes, edges, communities, 1)
    assert set(hybrid) == {"chunks", "context", "summaries"}
    assert R.prompts(R.contexts(asked, texts, local)).where("query_id = 1").first().prompt.endswith("Question: Where does the mill stand?\n\nAnswer:")
    assert CO.has_summaries(communities)
