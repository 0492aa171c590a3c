"""Whole pipelines: index a folder, build the graph, ask questions, benchmark.

All state is tables under one folder: chunks, vectors, extractions, graph/nodes,
graph/edges, members, communities and the manifest of what is indexed.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholaspark.config import get_settings
from scholaspark.lineage import cut, scope
from scholaspark.operators import benchmark as B
from scholaspark.operators import chunking as C
from scholaspark.operators import communities as CO
from scholaspark.operators import documents as D
from scholaspark.operators import extraction as X
from scholaspark.operators import graph as G
from scholaspark.operators import metrics as M
from scholaspark.operators import retrieval as R
from scholaspark.operators.models import Model, judged
from scholaspark.operators.vectors import VectorIndex
from scholaspark.sources import files as S
from scholaspark.tables import settled


@dataclass(frozen=True)
class Models:
    """The models a workspace works with, each a function; None for the default
    that needs none. ``names`` are what benchmark records tell of them."""

    embed: R.Embedder = R.hashed_embedding
    generate: Model | None = None
    extract: X.Model = X.capitalised_names
    repair: X.Model | None = None
    fallback: X.Model | None = None
    summarise: Model | None = None
    judge: Model | None = None
    names: dict[str, str] = field(default_factory=dict)


class Workspace:
    """The tables of one folder, and the models they are made with."""

    def __init__(self, spark: SparkSession, folder: str, models: Models | None = None):
        self.spark, self.folder, self.models = settled(spark), folder.rstrip("/"), models or Models()

    def has(self, name: str) -> bool:
        return S._matches(self.spark, f"{self.folder}/{name}/*")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def write(self, df: DataFrame, name: str, mode: str = "overwrite") -> None:
        df.write.mode(mode).parquet(f"{self.folder}/{name}")

    def index(self, source: str, resume: bool = True, limit: int | None = None) -> int:
        """Chunks and embeds the documents of a folder that aren't indexed yet;
        returns the number of vectors. The manifest is written last, so a run
        that broke off is done again."""
        with scope():
            self._index(source, resume, limit)
        return self.read("vectors").count()

    def _index(self, source: str, resume: bool, limit: int | None) -> None:
        docs = D.first_loads(S.read_documents(self.spark, source), ["doc_id"], [F.col("source_file"), F.xxhash64("text")])
        if resume and self.has("manifest"):
            docs = D.not_indexed(docs, self.read("manifest"))
        if limit is not None:
            docs = docs.orderBy("doc_id").limit(limit)
        docs = cut(docs)
        mode = "append" if resume else "overwrite"
        chunks = cut(C.prepare_and_chunk(docs))
        if self.has("chunks") and resume:
            chunks = chunks.join(self.read("chunks").select("chunk_id"), "chunk_id", "left_anti")
        chunks = cut(chunks)
        self.write(chunks, "chunks", mode)
        self.write(R.embedded(chunks, "chunk_id", "text", "chunk_id", self.models.embed), "vectors", mode)
        self.write(docs.select("doc_id"), "manifest", mode)

    def extract(self) -> None:
        """Extracts the chunks that have no result yet."""
        m = self.models
        chunks = self.read("chunks")
        if self.has("extractions"):
            chunks = S.not_extracted(chunks, self.read("extractions"))
        with scope():
            self.write(cut(X.extract(chunks, m.extract, m.repair, m.fallback)), "extractions", "append")

    def build_graph(self, extractions: DataFrame | None = None, good_only: bool = False, summaries: int | None = None) -> None:
        """Graph and communities of all results, or of the good ones."""
        rows = self.read("extractions") if extractions is None else extractions
        rows = G.good_only(rows) if good_only else rows
        order = [F.regexp_replace("chunk_id", r"\d+$", ""), F.regexp_extract("chunk_id", r"(\d+)$", 1).try_cast("long"), F.col("status")]
        S.write_graph(G.nodes(rows, order), G.edges(rows, order), f"{self.folder}/graph")
        self.write(G.chunk_entities(rows, order), "chunk_entities")
        self.refresh_communities(summaries)

    def refresh_communities(self, summaries: int | None = None) -> None:
        """Detects and summarises communities again; all, or the largest."""
        nodes, edges = S.read_graph(self.spark, f"{self.folder}/graph")
        with scope():
            members = cut(CO.detect(nodes, edges))
            told = CO.summarise(members, nodes, edges, limit=summaries) if self.models.summarise is None else CO.summarise_by_model(members, nodes, edges, self.models.summarise, summaries)
            self.write(members, "members")
            self.write(cut(CO.community_table(members, told)), "communities")

    def search(self, questions: DataFrame, mode: str = "vector", top_k: int | None = None, index: VectorIndex | None = None) -> dict[str, DataFrame]:
        """Retrieval for (query_id, question) in one of the modes; by an index of
        the vectors if one is given, else by the exact search."""
        k, hops, embed = top_k or get_settings().top_k, get_settings().expansion_hops, self.models.embed
        if mode == "vector":
            return {"chunks": R.vector_search(questions, self.read("vectors"), k, embed, index)}
        if mode not in R.MODES:
            raise ValueError(f"unknown mode: {mode}")
        nodes, edges = S.read_graph(self.spark, f"{self.folder}/graph")
        if mode == "graph_only":
            return R.graph_only_search(questions, nodes, edges, k, hops, embed)
        found: dict[str, DataFrame] = {}
        if mode in ("local", "hybrid"):
            found |= R.local_search(questions, self.read("vectors"), self.read("chunk_entities"), nodes, edges, k, hops, embed, index)
        if mode in ("global", "hybrid"):
            found |= R.global_search(questions, self.read("communities"), k, embed)
        return found

    def results(self, found: dict[str, DataFrame]) -> DataFrame:
        """The found chunks with their texts and metadata."""
        return R.results(found["chunks"], self.read("chunks"))

    def index_vectors(self) -> VectorIndex:
        """An index of the workspace's vectors, for searches beyond full scans."""
        return VectorIndex.build(self.read("vectors"), "chunk_id")

    def answer(self, questions: DataFrame, mode: str = "vector", top_k: int | None = None) -> DataFrame:
        """(query_id, question, context, answer)."""
        asked = cut(R.contexts(questions, self.read("chunks"), self.search(questions, mode, top_k)))
        return asked.join(R.answers(asked, self.models.generate), "query_id")

    def benchmark(self, questions: DataFrame, modes: tuple[str, ...] = R.MODES, top_k: int | None = None, run_id: str = "", timestamp_utc: str = "") -> DataFrame:
        """Benchmark records of questions (question_id, question,
        reference_answer, relevant_doc_ids, question_scope), one per mode.
        Without a judge the judged metrics are 0. The latency of a record is its
        share of the time that its mode took for all questions."""
        k = top_k or get_settings().top_k
        asked = cut(B.questions_of(questions).withColumnRenamed("question_id", "query_id"))
        n = max(asked.count(), 1)
        every = None
        for number, mode in enumerate(modes):
            began = time.monotonic()
            found = self.search(asked, mode, k)
            if "chunks" in found:
                found["chunks"] = cut(found["chunks"])
            context = cut(R.contexts(asked, self.read("chunks"), found))
            answers = cut(context.join(R.answers(context, self.models.generate), "query_id"))
            took = (time.monotonic() - began) / n
            rows = self._judged(asked.join(answers.drop("question"), "query_id").join(self._payload(asked, found), "query_id"))
            rows = rows.withColumn("docs", M.as_documents(F.col("ids"))).withColumn("rouge", M.rouge_scores("answer", "reference_answer"))
            relevant = F.col("relevant_doc_ids")
            hits = M.hits_at_k(F.col("docs"), relevant, k)
            rows = rows.select(
                (F.col("query_id") * len(modes) + number).alias("record_id"), "question", F.lit("rag" if mode == "vector" else f"graphrag_{mode}").alias("pipeline"), "question_scope", F.lit(run_id).alias("run_id"), F.lit(timestamp_utc).alias("timestamp_utc"), F.lit(mode).alias("search_mode"),
                *(F.lit(v).alias(c) for c, v in self._names().items()), F.lit(k).alias("top_k"), "answer", F.lit(took).alias("latency_s"),
                M.precision_at_k(F.col("docs"), relevant, k).alias("precision_5"), M.recall_at_k(F.col("docs"), relevant, k).alias("recall_5"), M.reciprocal_rank(F.col("docs"), relevant).alias("mrr"), F.col("rouge.rouge1").alias("rouge1"), F.col("rouge.rougel").alias("rougel"),
                *B.QUALITY, F.size(F.array_distinct(relevant)).alias("relevant_doc_count"), F.size("ids").alias("retrieved_count"), hits.alias("relevant_hits_at_k"), F.lit(False).alias("has_relevant_hit_at_k"),
                F.to_json("ids").alias("retrieved_chunk_ids"), F.to_json(F.slice("ids", 1, 5)).alias("retrieved_chunk_ids_top5"), F.to_json("payload.score").alias("retrieved_chunk_scores"), F.to_json(F.array_sort("docs")).alias("retrieved_doc_ids"),
                F.to_json("payload").alias("retrieved_chunk_payload"), F.to_json(F.slice("payload", 1, 5)).alias("retrieved_chunk_payload_top5"), *(f"{m}_rationale" for m in B.QUALITY), B.judge_notes(F.col("faithfulness"), hits).alias("judge_validation_notes"), F.length("context").alias("context_char_count"), "context",
            )
            every = rows if every is None else every.unionByName(rows)
        every = cut(every)
        tokens = C.token_counts(every, "record_id", "context").withColumnRenamed("n_tokens", "estimated_context_tokens")
        return every.drop("context").join(tokens, "record_id").withColumns(M.validated())

    def _names(self) -> dict[str, str]:
        s = get_settings()
        known = {"llm_provider": s.llm_provider, "llm_model": s.llm_model_name, "embedding_provider": s.embedding_provider, "embedding_model": s.embedding_model_name}
        return {c: self.models.names.get(c, v) for c, v in known.items()}

    def _payload(self, asked: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
        """(query_id, ids, payload): the found chunks by rank, as their ids and
        as they are shown; at most top_k of a question."""
        kind = "array<struct<rank:int,chunk_id:string,score:double,text:string,metadata:map<string,string>>>"
        none = F.array().cast(kind)
        if "chunks" in found:
            by = F.sort_array(F.collect_list(F.struct("rank", F.struct("chunk_id", F.round("score", 6).alias("score"), "text", F.to_json("metadata").alias("metadata")).alias("x"))))
            listed = self.results(found).groupBy("query_id").agg(F.transform(by, lambda r: F.struct(r["rank"].alias("rank"), r["x"]["chunk_id"].alias("chunk_id"), r["x"]["score"].alias("score"), r["x"]["text"].alias("text"), F.from_json(r["x"]["metadata"], "map<string,string>").alias("metadata"))).alias("payload"))
            rows = asked.select("query_id").join(listed, "query_id", "left").withColumn("payload", F.coalesce("payload", none))
        else:
            rows = asked.select("query_id", none.alias("payload"))
        return rows.select("query_id", F.col("payload.chunk_id").alias("ids"), "payload")

    def _judged(self, rows: DataFrame) -> DataFrame:
        """The rows with the judges' scores and reasons."""
        if self.models.judge is None:
            return rows.select("*", *(F.lit(0.0).alias(m) for m in B.QUALITY), *(F.lit("").alias(f"{m}_rationale") for m in B.QUALITY))
        scores = judged(rows, self.models.judge, B.QUALITY).groupBy("query_id").pivot("metric", list(B.QUALITY)).agg(F.first("score").alias("s"), F.first("rationale").alias("r"))
        scores = scores.select("query_id", *(F.coalesce(f"{m}_s", F.lit(0.0)).alias(m) for m in B.QUALITY), *(F.coalesce(f"{m}_r", F.lit("")).alias(f"{m}_rationale") for m in B.QUALITY))
        return rows.join(scores, "query_id", "left").fillna(0.0, list(B.QUALITY)).fillna("", [f"{m}_rationale" for m in B.QUALITY])
