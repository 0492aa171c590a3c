"""Benchmark records: aggregates, review table, report, checks before a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholaspark.operators.metrics import json_list

#: What an answer says that only falls back.
FALLBACK_PATTERNS = ("not enough context", "insufficient context", "do not have enough context", "doesn't contain any information", "does not contain any information", "please provide the text", "i need the context", "cannot answer", "can't answer", "unable to answer")
QUALITY = ("faithfulness", "comprehensiveness", "diversity", "directness", "empowerment")


def zero(column: str) -> Column:
    """A value of a record, null counting as 0."""
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def is_fallback(answer: Column) -> Column:
    text = F.trim(F.lower(F.coalesce(answer, F.lit(""))))
    found = F.lit(False)
    for pattern in FALLBACK_PATTERNS:
        found = found | text.contains(pattern)
    return found


def is_empty(answer: Column) -> Column:
    return F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?U)\s+", "") == ""


def aggregates(records: DataFrame, *keys: str) -> DataFrame:
    """Rows, averages (null counts as 0) and rates by the keys."""
    rate = lambda c: F.avg(c.cast("double"))
    return records.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        *(F.avg(zero(c)).alias(c) for c in ("rouge1", "rougel", *QUALITY, "precision_5", "recall_5", "mrr", "latency_s", "context_char_count")),
        rate(is_fallback(F.col("answer"))).alias("fallback_rate"),
        rate(is_empty(F.col("answer"))).alias("empty_rate"),
    )


def tiers(records: DataFrame) -> DataFrame:
    """(tier, available, active): which kinds of metrics a run has."""
    on = lambda c: F.coalesce(F.max((zero(c) > 0).cast("int")), F.lit(0)).alias(c)
    groups = {"judges": QUALITY, "efficiency": ("latency_s", "context_char_count"), "retrieval": ("precision_5", "recall_5", "mrr")}
    one = records.agg(*(on(c) for group in groups.values() for c in group))
    rows = F.array(*(F.struct(F.lit(t).alias("tier"), F.array_compact(F.array(*(F.when(F.col(c) == 1, c) for c in group))).alias("active")) for t, group in groups.items()))
    return one.select(F.explode(rows).alias("x")).select("x.tier", (F.size("x.active") > 0).alias("available"), F.array_join("x.active", ", ").alias("active"))


def extremes(records: DataFrame, metric: str = "rouge1", key: str = "record_id") -> DataFrame:
    """(example, record): the best and the worst record by a metric; of ties the
    last and the first by key, and one representative if both are the same."""
    value = F.struct(zero(metric).alias("v"), F.col(key).alias("k"))
    one = records.agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low is not null")
    same = F.col("low.k") == F.col("high.k")
    rows = F.when(same, F.array(F.struct(F.lit("representative").alias("example"), F.col("high").alias("at")))).otherwise(
        F.array(F.struct(F.lit("best").alias("example"), F.col("high").alias("at")), F.struct(F.lit("worst").alias("example"), F.col("low").alias("at")))
    )
    return one.select(F.explode(rows).alias("x")).select("x.example", F.col("x.at.k").alias(key), F.col("x.at.v").alias(metric))


def leaders(summary: DataFrame) -> DataFrame:
    """(what, pipeline, value): the pipelines a report names, from aggregates()
    by pipeline. Ties go to the later name where the most is asked for, and to
    the earlier where the least is."""
    most = lambda c: F.max(F.struct(F.col(c).alias("v"), F.col("pipeline").alias("p")))
    least = lambda c: F.min(F.struct(F.col(c).alias("v"), F.col("pipeline").alias("p")))
    asked = {"highest_fallback": most("fallback_rate"), "lowest_latency": least("latency_s"), "largest_context": most("context_char_count"), "best_rouge1": most("rouge1"), "best_faithfulness": most("faithfulness")}
    one = summary.agg(*(c.alias(n) for n, c in asked.items()))
    rows = F.array(*(F.struct(F.lit(n).alias("what"), F.col(f"{n}.p").alias("pipeline"), F.col(f"{n}.v").alias("value")) for n in asked))
    return one.select(F.explode(rows).alias("x")).select("x.*").where("pipeline is not null")


def judge_notes(faithfulness: Column, hits: Column) -> Column:
    """What a reviewer should look at."""
    f, h = F.coalesce(faithfulness, F.lit(0.0)), F.coalesce(hits, F.lit(0))
    low = F.when((f < 0.5) & (h == 0), F.lit("Low faithfulness aligns with no relevant retrieval hit in top-k."))
    odd = F.when((h > 0) & (f < 0.4), F.lit("Potential contradiction: relevant hit exists but faithfulness is low."))
    return F.concat_ws(" ", low, odd)


#: Fixed value: characters of a chunk's text that a review shows.
SHOWN_TEXT = 1200
PAYLOAD = "array<struct<rank:int,chunk_id:string,score:double,text:string,metadata:map<string,string>>>"


def review(records: DataFrame, chunk_limit: int = 5) -> DataFrame:
    """The table for reading by people, with the first chunks as lines, and with
    their texts and the judges' reasons where the records carry them."""
    there = records.columns
    ids = F.slice(json_list(F.col("retrieved_chunk_ids")), 1, chunk_limit)
    lines = F.array_join(F.transform(ids, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    extra = []
    if "retrieved_chunk_payload" in there:
        shown = F.slice(F.from_json("retrieved_chunk_payload", PAYLOAD), 1, chunk_limit)
        text = lambda c: F.replace(F.trim(F.coalesce(c["text"], F.lit(""))), F.lit("\n"), F.lit(" "))
        cut = lambda t: F.when(F.length(t) > SHOWN_TEXT, F.concat(F.left(t, F.lit(SHOWN_TEXT)), F.lit("..."))).otherwise(t)
        details = F.transform(shown, lambda c: F.concat(c["rank"].cast("string"), F.lit(". "), c["chunk_id"], F.lit(" (score "), F.format_number(c["score"], 4), F.lit("): "), cut(text(c)), F.coalesce(F.concat(F.lit(" | "), F.to_json(c["metadata"])), F.lit(""))))
        extra.append(F.coalesce(F.array_join(details, "\n"), F.lit("")).alias("top_k_chunk_details"))
    extra += [F.coalesce(f"{m}_rationale", F.lit("")).alias(f"{m}_rationale") for m in QUALITY if f"{m}_rationale" in there]
    return records.select(
        F.coalesce("question_scope", F.lit("local")).alias("question_scope"), "question", "pipeline", "search_mode", "answer", lines.alias("top_k_chunks"), "retrieved_count", "relevant_hits_at_k",
        *(zero(c).alias(c) for c in ("precision_5", "recall_5", "mrr", *QUALITY, "latency_s")),
        judge_notes(F.col("faithfulness"), F.col("relevant_hits_at_k")).alias("judge_validation_notes"), *extra,
    )


def review_markdown(table: DataFrame, run_id: str, timestamp_utc: str) -> DataFrame:
    """(value): the review as lines of Markdown, in order of scope, question and
    pipeline. A section is made where its row is; only the order is shared."""
    there = table.columns
    text = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(none)")) if c in there else F.lit("(none)")
    number = lambda c: F.format_number(F.col(c), 3)
    figures = {"P@k": "precision_5", "R@k": "recall_5", "MRR": "mrr", **{m.title(): m for m in QUALITY}, "Latency (s)": "latency_s"}
    reasons = [m for m in QUALITY if f"{m}_rationale" in there]
    asked = Window.partitionBy("question_scope", "question").orderBy("pipeline", "search_mode", "answer")
    opened = F.when(F.row_number().over(asked) == 1, F.concat(F.lit("## "), F.initcap("question_scope"), F.lit(" question: "), F.coalesce("question", F.lit("")), F.lit("\n\n"))).otherwise("")
    section = F.concat(
        opened, F.lit("### "), "pipeline", F.lit(" ("), F.coalesce("search_mode", F.lit("")), F.lit(")\n\n**Answer**\n\n"), text("answer"),
        F.lit("\n\n**Retrieved chunks**\n\n"), text("top_k_chunks"), F.lit("\n\n**Their texts**\n\n"), text("top_k_chunk_details"), F.lit("\n\n**Metrics** "),
        F.concat_ws(", ", *(F.concat(F.lit(f"{n}: "), number(c)) for n, c in figures.items())),
        *(F.concat(F.lit(f"\n- {m.title()}: "), text(f"{m}_rationale")) for m in reasons),
        F.when(F.col("judge_validation_notes") != "", F.concat(F.lit("\n\n**Note** "), "judge_validation_notes")).otherwise(""), F.lit("\n"),
    )
    rows = table.select(F.when(F.col("question_scope") == "local", 1).otherwise(2).alias("part"), "question_scope", "question", "pipeline", "search_mode", section.alias("value"))
    head = table.groupBy().count().select(F.lit(0).alias("part"), F.concat(F.lit(f"# Benchmark Human Review\n\n- run_id: {run_id}\n- timestamp_utc: {timestamp_utc}\n- rows: "), F.col("count").cast("string"), F.lit("\n")).alias("value"))
    return rows.unionByName(head, allowMissingColumns=True).orderBy("part", "question_scope", "question", "pipeline", "search_mode", "value").select("value")


def head_to_head(records: DataFrame, metric: str, one: str = "rag") -> DataFrame:
    """(pipeline, wins, losses, ties) of every other pipeline against one, by
    each question's average."""
    each = records.withColumn("q", F.trim("question")).groupBy("q", "pipeline").agg(F.avg(zero(metric)).alias("v"))
    base = each.where(F.col("pipeline") == one).select("q", F.col("v").alias("b"))
    both = each.where(F.col("pipeline") != one).join(base, "q")
    n = lambda c: F.sum(c.cast("long"))
    gap = F.col("v") - F.col("b")
    return both.groupBy("pipeline").agg(n(gap > 1e-9).alias("wins"), n(gap < -1e-9).alias("losses"), n(F.abs(gap) <= 1e-9).alias("ties"))


def report(records: DataFrame, run_id: str, questions: str, timestamp_utc: str, top_k: int = 5) -> str:
    """The Markdown report of a run. Only aggregates come to the driver."""
    summary = aggregates(records, "pipeline").cache()
    rows = summary.orderBy("pipeline").collect()
    found = {r.what: r for r in leaders(summary).collect()}
    summary.unpersist()
    out = [f"# Benchmark Report: Run {run_id[:8]}", "", "## 1. Run Configuration", "", f"- Run ID: {run_id}", f"- Run timestamp (UTC): {timestamp_utc}", f"- Question file used: {questions}", f"- Top-k: {top_k}"]
    out += [f"- Pipelines evaluated: {', '.join(r.pipeline or '' for r in rows) or '(none)'}", "", "## 2. Tier Coverage Check", ""]
    out += [f"- {r.tier}: {'available via ' + r.active if r.available else 'unavailable or all zero in this run'}" for r in tiers(records).collect()]
    out += ["", "## 3. Aggregate Results", "", "|Pipeline|Rows|rouge1|rougeL|faithfulness|latency_s|fallback_rate|empty_answer_rate|", "|" + "---|" * 8]
    out += [f"|{r.pipeline}|{r.n_rows}|{r.rouge1:.4f}|{r.rougel:.4f}|{r.faithfulness:.4f}|{r.latency_s:.4f}|{r.fallback_rate:.1%}|{r.empty_rate:.1%}|" for r in rows] or ["- No rows available."]
    out += ["", "## 4. Reliability and Failure Summary", ""] + [f"- {n.replace('_', ' ')}: `{found[n].pipeline}` at {found[n].value:.4f}" for n in ("highest_fallback", "lowest_latency", "largest_context") if n in found]
    out += ["", "## 5. Best and Worst Examples", ""]
    for r in extremes(records).join(records.dropDuplicates(["record_id"]).select("record_id", "question", "pipeline", "answer"), "record_id").orderBy("example").collect():
        answer = " ".join((r.answer or "").split())
        out += [f"### {r.example.title()} Example", "", f"- Question: {r.question}", f"- Pipeline: {r.pipeline}", f"- rouge1: {r.rouge1:.4f}", f"- Answer snippet: {answer if len(answer) <= 240 else answer[:237] + '...'}", ""]
    out += ["## 6. Recommendations", ""]
    if not rows:
        return "\n".join([*out, "- No results were available to summarise.", ""])
    out.append(f"- Keep `{found['best_rouge1'].pipeline}` as the baseline of lexical quality.")
    if found["best_faithfulness"].value > 0:
        out.append(f"- `{found['best_faithfulness'].pipeline}` is strongest on faithfulness.")
    if found["highest_fallback"].value > 0.2:
        out.append(f"- Look into `{found['highest_fallback'].pipeline}`: {found['highest_fallback'].value:.1%} of its answers fall back.")
    if all(r.precision_5 == 0 for r in rows):
        out.append("- Fill in `relevant_doc_ids`, so that the retrieval metrics mean something.")
    return "\n".join([*out, ""])


def questions_of(raw: DataFrame) -> DataFrame:
    """Evaluation questions put into form: trimmed, scopes supported, empty ids
    dropped; a question without text is no question. Of equal questions,
    whatever their case, the first by id stays."""
    from scholaspark.operators.metrics import scope

    q = raw.select(
        "question_id", F.trim("question").alias("question"), F.trim(F.coalesce("reference_answer", F.lit(""))).alias("reference_answer"),
        F.filter(F.transform(F.coalesce("relevant_doc_ids", F.array().cast("array<string>")), F.trim), lambda x: x != "").alias("relevant_doc_ids"), scope(F.col("question_scope")).alias("question_scope"),
    ).where("question is not null and question <> ''")
    rank = F.row_number().over(Window.partitionBy(F.lower("question")).orderBy("question_id"))
    return q.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def preflight(questions: DataFrame, vectors: DataFrame | None, edges: DataFrame | None, communities: DataFrame | None, modes: tuple[str, ...] = ("local", "global", "graph_only", "hybrid")) -> list[str]:
    """Notes on what a benchmark needs; raises with all that is missing."""
    from scholaspark.operators.communities import has_summaries

    notes, errors = [], []
    n = questions.count()
    (notes if n else errors).append(f"questions: {n}")
    for name, table in (("vectors", vectors), ("graph", edges)):
        there = table is not None and table.limit(1).count() > 0
        (notes if there else errors).append(f"{name}: {'present' if there else 'missing or empty'}")
    if {"global", "hybrid"} & set(modes):
        there = communities is not None and has_summaries(communities)
        (notes if there else errors).append(f"community summaries: {'present' if there else 'missing'}")
    else:
        notes.append("community summaries: not needed")
    if errors:
        raise RuntimeError("benchmark preflight failed: " + "; ".join(errors))
    return notes
