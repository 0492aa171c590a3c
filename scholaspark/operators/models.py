"""Work with language models. A model is a function from a list of prompts to a
list of replies, None for a failed one; nothing here knows whose it is."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholaspark.operators.metrics import judge_reply

Model = Callable[[list[str]], list[str | None]]

#: What judges are asked, by metric: (what is judged, whether it sees a context).
JUDGED = {
    "faithfulness": ("whether every claim of the answer is supported by the context", True),
    "comprehensiveness": ("how many of the context's points that matter to the question the answer covers", True),
    "diversity": ("how many different sides of the matter the answer shows", True),
    "directness": ("how directly the answer says what was asked", False),
    "empowerment": ("how well the answer lets a reader understand and act", True),
}


def retrying(model: Model, retries: int = 5, initial: float = 1.0, factor: float = 2.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Model:
    """A model that is asked again, after growing pauses, when a call fails.
    After the last try the replies are None."""

    def call(prompts: list[str]) -> list[str | None]:
        pause = initial
        for attempt in range(retries + 1):
            try:
                return model(prompts)
            except Exception:
                if attempt == retries:
                    return [None] * len(prompts)
                sleep(min(pause, longest))
                pause *= factor
        return [None] * len(prompts)

    return call


def replies(prompts: DataFrame, key: str, prompt: str, model: Model, batch_size: int = 64) -> DataFrame:
    """(key, reply) of every prompt; null prompts aren't sent."""
    kind = dict(prompts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, batch_size):
                part = batch.slice(first, batch_size)
                asked = part.column(1).to_pylist()
                sent = [p for p in asked if p is not None]
                got = iter(model(sent) if sent else [])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if p is None else next(got) for p in asked], pa.string())], [key, "reply"])

    return prompts.select(key, prompt).mapInArrow(run, f"`{key}` {kind}, reply string")


def judge_prompt(metric: str, question, answer, context):
    """The prompt of a judge, as a column."""
    what, sees = JUDGED[metric]
    parts = [F.lit(f"Judge {what}, from 0.0 (not at all) to 1.0 (wholly).\n\nQuestion:\n"), F.coalesce(question, F.lit(""))]
    if sees:
        parts += [F.lit("\n\nContext:\n"), F.coalesce(context, F.lit(""))]
    return F.concat(*parts, F.lit("\n\nAnswer:\n"), F.coalesce(answer, F.lit("")), F.lit('\n\nReply with JSON only: {"score": <number>, "rationale": "<two sentences at most>"}'))


def judged(answers: DataFrame, model: Model, metrics: tuple[str, ...] = tuple(JUDGED), key: str = "query_id") -> DataFrame:
    """(key, metric, score, rationale) of answers (key, question, context,
    answer). Without a context nothing is judged but directness."""
    rows = None
    for metric in metrics:
        asked = answers.where(F.trim(F.coalesce("context", F.lit(""))) != "") if JUDGED[metric][1] else answers
        asked = asked.select(key, judge_prompt(metric, F.col("question"), F.col("answer"), F.col("context")).alias("prompt"))
        scored = replies(asked, key, "prompt", model).select(key, F.lit(metric).alias("metric"), judge_reply(F.col("reply")).alias("j")).select(key, "metric", "j.score", "j.rationale")
        rows = scored if rows is None else rows.unionByName(scored)
    return rows


def questions_in_reply(raw: str | None) -> list[tuple[str, str]]:
    """(question, reference answer) of a reply that holds a JSON array."""
    text = re.sub(r"```(?:json)?\s*", "", raw or "")
    a, b = text.find("["), text.rfind("]")
    try:
        data = json.loads(text[a : b + 1]) if 0 <= a < b else []
    except ValueError:
        return []
    rows = [(str(x.get("question", "")).strip(), str(x.get("reference_answer", "")).strip()) for x in data if isinstance(x, dict)]
    return [r for r in rows if r[0]]


def generated_questions(abstracts: DataFrame, key: str, text: str, model: Model, each: int = 2) -> DataFrame:
    """(key, question, reference_answer) made from abstracts by a model; of
    equal questions, whatever their case, that of the least key stays."""
    asked = abstracts.where(F.trim(F.coalesce(text, F.lit(""))) != "").select(key, F.concat(F.lit(f"Write {each} questions with answers about this abstract, as a JSON array of objects with question and reference_answer.\n\nAbstract:\n"), F.trim(text)).alias("prompt"))
    kind = dict(asked.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *r) for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in questions_in_reply(raw)]
            columns = list(zip(*rows)) or [[]] * 3
            kinds = batch.schema.field(0).type, pa.string(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], [key, "question", "reference_answer"])

    rows = replies(asked, key, "prompt", model).mapInArrow(run, f"`{key}` {kind}, question string, reference_answer string")
    first = rows.groupBy(F.lower("question").alias("_q")).agg(F.min(F.struct(key, "question", "reference_answer")).alias("x"))
    return first.select(f"x.{key}", "x.question", "x.reference_answer")


#: Stands for what no taxonomy names.
UNKNOWN_LABEL = "unknown"


def classified(papers: DataFrame, taxonomy: list[str], model: Model | None = None) -> DataFrame:
    """(doc_id, title, label, confidence): the label of the taxonomy that a model
    replies with; unknown (confidence 0) without a model or with another reply."""
    if model is None:
        return papers.select("doc_id", "title", F.lit(UNKNOWN_LABEL).alias("label"), F.lit(0.0).alias("confidence"))
    prompt = F.concat(F.lit(f"Which of these fields does the paper belong to: {', '.join(taxonomy)}? Reply with the field only.\n\nTitle: "), F.coalesce("title", F.lit("")))
    got = replies(papers.select("doc_id", prompt.alias("prompt")), "doc_id", "prompt", model)
    label = F.try_element_at(F.filter(F.array(*map(F.lit, taxonomy)), lambda t: F.lower(t) == F.lower(F.trim("reply"))), F.lit(1))
    return papers.select("doc_id", "title").join(got, "doc_id").select("doc_id", "title", F.coalesce(label, F.lit(UNKNOWN_LABEL)).alias("label"), F.when(label.isNotNull(), 1.0).otherwise(0.0).alias("confidence"))
