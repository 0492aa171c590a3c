"""Retrieval for many questions at once: vector, local, global, graph-only and
hybrid search, and the context and answer made of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholaspark.operators import graph as G
from scholaspark.operators.models import Model, replies
from scholaspark.operators.vectors import VectorIndex, hashed_embedding, search

MODES = ("vector", "local", "global", "graph_only", "hybrid")
#: An embedding: from a column of texts to one of array<float>.
Embedder = Callable[[Column], Column]
#: Lines of the graph that one context holds at most, in order; a hub's context
#: would not fit any model. The search's own rows are whole.
CONTEXT_LINES = 2_000


def embedded(df: DataFrame, key: str, text: str, name: str, embed: Embedder = hashed_embedding) -> DataFrame:
    """(name, embedding) of the texts."""
    return df.select(F.col(key).alias(name), embed(F.col(text)).alias("embedding"))


def _asked(questions: DataFrame, embed: Embedder) -> DataFrame:
    return questions.select("query_id", embed(F.col("question")).alias("embedding"))


def vector_search(questions: DataFrame, vectors: DataFrame, top_k: int = 5, embed: Embedder = hashed_embedding, index: VectorIndex | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the chunks nearest to each question.

    ``questions`` has (query_id, question), ``vectors`` (chunk_id, embedding) by
    the same embedding. With an index of the vectors, only near cells are looked
    through.
    """
    found = index.search(_asked(questions, embed), top_k) if index else search(vectors, _asked(questions, embed), top_k, id_column="chunk_id")
    return found.withColumnRenamed("id", "chunk_id")


def results(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, rank, text, metadata): found chunks as they
    are shown; null metadata where the chunks carry none."""
    metadata = F.col("metadata") if "metadata" in chunks.columns else F.lit(None).cast("map<string,string>")
    shown = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"), metadata.alias("metadata"))
    return found.join(shown, "chunk_id").select("query_id", "chunk_id", "score", "rank", "text", "metadata")


def local_search(questions: DataFrame, vectors: DataFrame, chunk_entities: DataFrame, nodes: DataFrame, edges: DataFrame, top_k: int = 5, hops: int = 1, embed: Embedder = hashed_embedding, index: VectorIndex | None = None) -> dict[str, DataFrame]:
    """Vector search, and the graph around the entities its chunks support."""
    chunks = vector_search(questions, vectors, top_k, embed, index)
    seeds = chunks.select("query_id", "chunk_id").join(chunk_entities, "chunk_id").select("query_id", "node_id").distinct()
    members = G.expand(seeds, edges, hops)
    return {"chunks": chunks, "context": G.context_lines(members, nodes, edges, ["query_id"])}


def graph_only_search(questions: DataFrame, nodes: DataFrame, edges: DataFrame, top_k: int = 5, hops: int = 1, embed: Embedder = hashed_embedding) -> dict[str, DataFrame]:
    """The graph around the entities whose labels are nearest to the question."""
    labels = embedded(nodes, "node_id", "label", "node_id", embed)
    seeds = search(labels, _asked(questions, embed), top_k, id_column="node_id").select("query_id", F.col("id").alias("node_id"))
    return {"context": G.context_lines(G.expand(seeds, edges, hops), nodes, edges, ["query_id"])}


def global_search(questions: DataFrame, communities: DataFrame, top_n: int = 3, embed: Embedder = hashed_embedding) -> dict[str, DataFrame]:
    """The community summaries nearest to the question; empty ones don't count."""
    known = communities.where(F.trim(F.coalesce("summary", F.lit(""))) != "")
    near = search(embedded(known, "community_id", "summary", "community_id", embed), _asked(questions, embed), top_n, id_column="community_id")
    return {"summaries": near.withColumnRenamed("id", "community_id").join(known.select("community_id", "summary"), "community_id")}


def hybrid_search(questions: DataFrame, vectors: DataFrame, chunk_entities: DataFrame, nodes: DataFrame, edges: DataFrame, communities: DataFrame, top_k: int = 5, hops: int = 1, embed: Embedder = hashed_embedding, index: VectorIndex | None = None) -> dict[str, DataFrame]:
    """Local and global search together."""
    return local_search(questions, vectors, chunk_entities, nodes, edges, top_k, hops, embed, index) | global_search(questions, communities, top_k, embed)


def contexts(questions: DataFrame, chunk_texts: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """(query_id, context): chunks by rank, graph lines, summaries by rank."""
    parts = []
    if "chunks" in found:
        parts.append(found["chunks"].join(chunk_texts.select("chunk_id", "text"), "chunk_id").select("query_id", F.lit(0).alias("kind"), F.col("rank").cast("long").alias("place"), F.coalesce("text", F.lit("")).alias("part")))
    if "context" in found:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("line"))
        lines = found["context"].withColumn("place", place).where(F.col("place") <= CONTEXT_LINES).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("part"))
        parts.append(lines.select("query_id", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("place"), "part"))
    if "summaries" in found:
        parts.append(found["summaries"].select("query_id", F.lit(2).alias("kind"), F.col("rank").cast("long").alias("place"), F.col("summary").alias("part")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    joined = rows.where("part <> ''").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "place", "part"))), lambda x: x["part"]), "\n\n").alias("context"))
    return questions.select("query_id", "question").join(joined, "query_id", "left").select("query_id", "question", F.coalesce("context", F.lit("")).alias("context"))


#: Fixed value: how a question is put to a model.
PROMPT = "Context:\n{context}\n\nQuestion: {question}\n\nAnswer:"


def prompts(asked: DataFrame) -> DataFrame:
    """(query_id, prompt) for a model."""
    before, between, after = PROMPT.replace("{context}", "\x00").replace("{question}", "\x00").split("\x00")
    return asked.select("query_id", F.concat(F.lit(before), "context", F.lit(between), "question", F.lit(after)).alias("prompt"))


#: Fixed value: what is said where no answer could be had.
NO_ANSWER = "There is not enough context to answer."


def answers(asked: DataFrame, model: Model | None = None) -> DataFrame:
    """(query_id, answer) of (query_id, question, context): by a model, to which
    prompts go in batches (a failed call leaves NO_ANSWER), or by default taken
    from the context."""
    if model is None:
        return extractive_answers(asked)
    got = replies(prompts(asked), "query_id", "prompt", model)
    return got.select("query_id", F.coalesce("reply", F.lit(NO_ANSWER)).alias("answer"))


def extractive_answers(asked: DataFrame) -> DataFrame:
    """(query_id, answer): the default generator. The sentence of the context
    that shares most words with the question, the first of several; without a
    context it says that there is not enough."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)[^\w]+"), lambda w: w != ""))
    sentences = F.filter(F.split("context", r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")
    scored = F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(words(s), words(F.col("question")))).alias("n"), (-i).alias("at"), s.alias("s")))
    best = F.array_max(scored)["s"]
    return asked.select("query_id", F.coalesce(best, F.lit(NO_ANSWER)).alias("answer"))
