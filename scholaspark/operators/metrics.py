"""Retrieval and answer metrics, and how judges' replies are read."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scholaspark.functions.stem import stem
from scholaspark.functions.text import doc_of_chunk

#: Metrics between 0 and 1.
UNIT_METRICS = ("precision_5", "recall_5", "mrr", "rouge1", "rougel", "faithfulness", "comprehensiveness", "diversity", "directness", "empowerment")


def _none() -> Column:
    return F.array().cast("array<string>")


def _hits(retrieved: Column, relevant: Column, k: int) -> Column:
    known = F.coalesce(relevant, _none())
    return F.size(F.filter(F.slice(F.coalesce(retrieved, _none()), 1, k), lambda x: F.array_contains(known, x)))


def hits_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    """How many of the first k are relevant; repeated ids count each time."""
    return _hits(retrieved, relevant, k)


def precision_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    """hits / k; 0 if nothing was retrieved."""
    return _hits(retrieved, relevant, k) / F.lit(float(k))


def recall_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    """hits / number of relevant ids; 0 if there are none."""
    n = F.size(F.array_distinct(F.coalesce(relevant, _none())))
    return F.when(n > 0, _hits(retrieved, relevant, k) / n).otherwise(F.lit(0.0))


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    """1 / rank of the first relevant id; 0 if there is none."""
    known = F.coalesce(relevant, _none())
    ranks = F.transform(F.coalesce(retrieved, _none()), lambda x, i: F.when(F.array_contains(known, x), i + 1))
    first = F.array_min(ranks)
    return F.when(first.isNotNull(), F.lit(1.0) / first).otherwise(F.lit(0.0))


def as_documents(chunk_ids: Column) -> Column:
    """The documents of ranked chunks, each at its first rank."""
    return F.array_distinct(F.transform(F.coalesce(chunk_ids, _none()), doc_of_chunk))


def json_list(raw: Column) -> Column:
    """A JSON list of strings; malformed or null is empty."""
    return F.coalesce(F.from_json(raw, "array<string>"), _none())


@lru_cache(maxsize=100_000)
def _token(word: str) -> str:
    return stem(word) if len(word) > 3 else word


def rouge_tokens(text: str | None) -> list[str]:
    """The stems of a text's words; each word is stemmed once in a process."""
    return list(map(_token, re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).split()))


def _f1(common: int, a: int, b: int) -> float:
    if not common:
        return 0.0
    p, r = common / a, common / b
    return 2 * p * r / (p + r)


def rouge(prediction: str | None, reference: str | None) -> tuple[float, float]:
    """F1 of ROUGE-1 and ROUGE-L over stemmed words."""
    a, b = rouge_tokens(prediction), rouge_tokens(reference)
    if not a or not b:
        return 0.0, 0.0
    one = _f1(sum((Counter(a) & Counter(b)).values()), len(a), len(b))
    # Longest common subsequence, a bit per word of a.
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for w in b:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return one, _f1(len(a) - row.bit_count(), len(a), len(b))


@F.pandas_udf(StructType([StructField("rouge1", DoubleType()), StructField("rougel", DoubleType())]))
def rouge_scores(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rouge(p, r) for p, r in zip(prediction, reference)], columns=["rouge1", "rougel"])


def clamped(value: Column) -> Column:
    """Between 0 and 1; null is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.cast("double"), F.lit(0.0))))


def first_number(raw: Column) -> Column:
    """The first number of a judge's reply, clamped; 0 without one."""
    return clamped(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(\d+\.?\d*)", 1).try_cast("double"))


def judge_reply(raw: Column) -> Column:
    """(score, rationale) of a reply that is JSON or just holds a number."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(F.when(body != "", body), "score string, rationale string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    good = parsed.isNotNull() & parsed["_bad"].isNull()
    score = F.when(good, first_number(F.coalesce(parsed["score"], F.lit("0")))).otherwise(first_number(text))
    rationale = F.when(good, F.trim(F.coalesce(parsed["rationale"], F.lit("")))).otherwise(F.lit(""))
    return F.struct(score.alias("score"), rationale.alias("rationale"))


#: Scopes of questions.
SCOPES = ("local", "global")


def scope(raw: Column) -> Column:
    """A supported scope; any other is local."""
    plain = F.trim(F.lower(F.coalesce(raw, F.lit("local"))))
    return F.when(plain.isin(*SCOPES), plain).otherwise(F.lit("local"))


def validated() -> dict[str, Column]:
    """The columns of a benchmark record, put within their bounds."""
    least = lambda c, n: F.greatest(F.lit(n), F.coalesce(F.col(c), F.lit(n)).cast("int" if isinstance(n, int) else "double"))
    found = {c: clamped(F.col(c)) for c in UNIT_METRICS}
    found |= {c: least(c, 0) for c in ("relevant_doc_count", "retrieved_count", "relevant_hits_at_k", "context_char_count")}
    found |= {"top_k": least("top_k", 1), "latency_s": least("latency_s", 0.0), "question_scope": scope(F.col("question_scope"))}
    return found | {"has_relevant_hit_at_k": F.coalesce(F.col("relevant_hits_at_k"), F.lit(0)) > 0}
