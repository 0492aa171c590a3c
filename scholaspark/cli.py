"""Command line: python -m scholaspark.cli COMMAND ..."""

from __future__ import annotations

import argparse
import datetime
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scholaspark.config import get_settings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scholaspark")
    s = get_settings()
    p.add_argument("--folder", default=s.workspace_dir, help="folder of the tables")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *arguments: tuple) -> None:
        c = sub.add_parser(name, help=text)
        for flags, options in arguments:
            c.add_argument(*flags, **options)

    mode = (("--mode",), {"default": "vector", "choices": ["vector", "local", "global", "graph_only", "hybrid"]})
    top_k = (("--top-k",), {"type": int})
    optional = lambda name, folder: ((name,), {"nargs": "?", "default": folder})
    command("preprocess", "text files to paper records", optional("source", s.raw_data_dir), optional("target", s.processed_data_dir))
    command("index", "chunk and embed a folder", optional("source", s.processed_data_dir), (("--limit",), {"type": int}), (("--no-resume",), {"action": "store_true"}))
    command("extract", "entities and relations of the chunks")
    command("build-graph", "graph and communities of all results", (("--summary-limit",), {"type": int}))
    command("build-topology", "graph of a checkpoint's good results", (("checkpoint",), {}), (("--summary-limit",), {"type": int}))
    command("refresh-communities", "detect and summarise again", (("--summary-limit",), {"type": int}))
    command("search", "retrieve for a question", (("question",), {}), mode, top_k)
    command("query", "answer a question", (("question",), {}), mode, top_k)
    command("search-title", "documents by title", (("source",), {}), (("text",), {}), (("--top-n",), {"type": int, "default": 10}))
    command("questions-template", "a file of questions to begin with", (("target",), {}))
    command("preflight", "what a benchmark lacks", (("questions",), {}))
    command("benchmark", "records, review and report of a questions file", (("questions",), {}), optional("target", s.results_dir), (("--mode",), {"action": "append", "choices": mode[1]["choices"]}), top_k)
    command("artifacts", "tables for visualisers", (("target",), {}), (("--prefix",), {"action": "store_true"}))
    command("graphml", "the graph in GraphML", (("target",), {}))
    command("visualize", "a page with a sample of the graph", (("target",), {}), (("--max-nodes",), {"type": int, "default": 500}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> object:
    from scholaspark.operators import benchmark as B
    from scholaspark.operators import documents as D
    from scholaspark.operators import visual as V
    from scholaspark.plans.pipeline import Workspace
    from scholaspark.sources import files as S

    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("scholaspark").getOrCreate()
    w = Workspace(spark, a.folder)
    one = lambda: spark.createDataFrame([(1, a.question)], "query_id long, question string")
    if a.command == "preprocess":
        return S.preprocess_folder(spark, a.source, a.target)
    if a.command == "index":
        print(f"{(n := w.index(a.source, not a.no_resume, a.limit))} vectors")
        return n
    if a.command == "extract":
        return w.extract()
    if a.command == "build-graph":
        return w.build_graph(summaries=a.summary_limit)
    if a.command == "build-topology":
        return w.build_graph(S.read_checkpoint(spark, a.checkpoint), True, a.summary_limit)
    if a.command == "refresh-communities":
        return w.refresh_communities(a.summary_limit)
    if a.command == "search":
        found = w.search(one(), a.mode, a.top_k)
        for name, df in found.items():
            print(f"# {name}")
            df.show(50, truncate=120)
        return found
    if a.command == "query":
        print(answer := w.answer(one(), a.mode, a.top_k).first().answer)
        return answer
    if a.command == "search-title":
        rows = D.search_by_title(S.read_documents(spark, a.source), a.text, a.top_n).select("doc_id", "title").collect()
        for r in rows:
            print(f"{r.doc_id}\t{r.title}")
        return rows
    if a.command == "questions-template":
        return S.template_questions(spark).drop("question_id").coalesce(1).write.mode("overwrite").json(a.target)
    if a.command == "graphml":
        return S.write_graphml(*S.read_graph(spark, f"{a.folder}/graph"), a.target)
    if a.command == "artifacts":
        return V.write_artifacts(*S.read_graph(spark, f"{a.folder}/graph"), a.target, a.prefix)
    if a.command == "visualize":
        members = w.read("communities").select(F.explode("nodes").alias("node_id"), F.col("community_id").alias("community"))
        return V.write_html(*S.read_graph(spark, f"{a.folder}/graph"), members, a.target, a.max_nodes)
    questions = S.read_questions(spark, a.questions)
    if a.command == "preflight":
        table = lambda n: w.read(n) if w.has(n) else None
        notes = B.preflight(questions, table("vectors"), table("graph/edges"), table("communities"))
        print("\n".join(notes))
        return notes
    run_id, at = str(uuid.uuid4()), datetime.datetime.now(datetime.UTC).isoformat()
    modes = tuple(a.mode) if a.mode else ("vector", "local", "global", "graph_only", "hybrid")
    S.write_records(w.benchmark(questions, modes, a.top_k, run_id, at), f"{a.target}/records", "parquet")
    records = spark.read.parquet(f"{a.target}/records")
    S.write_records(records, f"{a.target}/benchmark_runs/{run_id}", "json")
    table = B.review(records)
    S.write_records(table, f"{a.target}/review", "csv")
    S.write_lines(B.review_markdown(table, run_id, at), f"{a.target}/review.md")
    text = B.report(records, run_id, a.questions, at, a.top_k or get_settings().top_k)
    S.write_lines(spark.createDataFrame([(text,)], "value string"), f"{a.target}/report.md")
    return text


if __name__ == "__main__":
    main()
