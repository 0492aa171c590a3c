import json

import pytest

from scholaspark.operators import models as O


def test_retries():
    tries, pauses = [], []

    def flaky(prompts):
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return ["ok"] * len(prompts)

    assert O.retrying(flaky, 5, 1.0, 2.0, 1.5, pauses.append)(["a", "b"]) == ["ok", "ok"] and pauses == [1.0, 1.5]
    tries.clear()
    assert O.retrying(flaky, 1, sleep=pauses.append)(["a"]) == [None]


@pytest.mark.parametrize(("raw", "want"), [('```json\n[{"question": " A? ", "reference_answer": 1}, {"x": 1}, "s"]\n```', [("A?", "1")]), ("text [broken", []), ("[1, 2", []), (None, []), ("[]", [])])
def test_questions_in_reply(raw, want):
    assert O.questions_in_reply(raw) == want


def test_judges_and_questions(spark):
    answers = spark.createDataFrame([(1, "q", "c", "a"), (2, None, " ", None)], "query_id int, question string, context string, answer string")

    def judge(prompts):
        return [json.dumps({"score": 0.7, "rationale": "r"}) if "Context" in p else "about 0.2" for p in prompts]

    got = {(r.query_id, r.metric): (r.score, r.rationale) for r in O.judged(answers, judge).collect()}
    assert got[(1, "faithfulness")] == (0.7, "r") and got[(2, "directness")] == (0.2, "") and len(got) == 6

    def ask(prompts):
        return ['[{"question": "Same?"}, {"question": "%s?"}]' % p[-1] for p in prompts]

    papers = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None), ("d", "")], "doc_id string, abstract string")
    got = sorted((r.doc_id, r.question) for r in O.generated_questions(papers, "doc_id", "abstract", ask).collect())
    assert got == [("a", "Same?"), ("a", "x?"), ("b", "y?")]
    assert O.replies(papers.limit(0), "doc_id", "abstract", ask).count() == 0


def test_classified(spark):
    papers = spark.createDataFrame([("a", "On maps"), ("b", None)], "doc_id string, title string")
    assert {r.label for r in O.classified(papers, ["x"]).collect()} == {"unknown"}
    got = {r.doc_id: (r.label, r.confidence) for r in O.classified(papers, ["Maps", "Text"], lambda ps: [" maps " if "maps" in p else "?" for p in ps]).collect()}
    assert got == {"a": ("Maps", 1.0), "b": ("unknown", 0.0)}
