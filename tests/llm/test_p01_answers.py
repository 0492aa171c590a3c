import itertools
import random

import numpy as np
import pytest

from scholaspark.llm import p01_answers as p1

COMMON = p1.common_words([type("R", (), {"lang": a, "word": w}) for a, ws in {
    "en": "the of and a in to is for that on with by are we be this it as not was but no each which if when has been",
    "de": "das der die und ist mit nicht dass wir auf dem ohne auch wird", "fr": "le la les de un une et est que pas dans nous par du au ne plus",
    "es": "el la los de un una y es que para no en con por se del más", "zh": "的 了 和 在"}.items() for w in ws.split()])


@pytest.fixture(scope="module")
def model():
    return p1.train(COMMON)


def test_held_out_clauses_are_tagged(model):
    rng = random.Random(99)
    right = total = 0
    for _ in range(400):
        question, parts, joint = p1._example(rng)
        _, rows = p1.features(question, joint.join(p for p, _ in parts), COMMON)
        if len(rows) == len(parts):
            tags = model.tag(rows)
            right += sum(a == b for a, (_, b) in zip(tags, parts))
            total += len(parts)
    assert total > 500 and right >= 0.95 * total


def test_viterbi_is_the_best_path(model):
    rng = np.random.default_rng(1)
    rows = (rng.random((4, len(p1.FEATURES))) < 0.2).astype(float)
    score = rows @ model.weight

    def value(tags):
        return score[range(4), tags].sum() + model.first[tags[0]] + model.final[tags[-1]] + sum(model.step[a, b] for a, b in itertools.pairwise(tags))

    best = max(itertools.product(range(5), repeat=4), key=value)
    assert value(model.tag(rows)) == pytest.approx(value(best))


QUESTION = "What limits the anchor of Kelmor on ship routing?"


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (None, "empty"), ("", "empty"), (" ​\n", "empty"), ("<answer></answer>", "empty"), ("N/A", "empty"), ("[no answer]", "empty"), ("Answer:", "empty"), ("…", "empty"),
        ("Yes.", None), ("A new rope", None), ("It drops to 4.1", None), ("Mainly through the slow winch of Kelmor. The rope is used for each of the ships [3]", None),
        ("What limits the anchor of Kelmor on ship routing? Mainly through the slow winch of Kelmor.", None),
        ("Mainly through the rope.\n1) old rope\n2) new winch", None),
        ("Mainly through the rope of Kelmor. The authors cannot answer why the rope fails and are sorry about the missing winch. The rope is not used twice.", None),
        ("what limits the anchor of kelmor on ship routing", "copy"), ("You asked: What limits the anchor of Kelmor on ship routing?", "copy"), ("What limits the old anchor of Kelmor on ship routing?", "copy"),
        ("I'm sorry, but I cannot answer that question.", "refusal"), ("No answer is possible.", "refusal"), ("Thank you for asking. I do not know. Please consult the authors.", "refusal"),
        ("Wir zeigen, dass das Seil nicht mit dem Anker hilft. Auch ohne das Seil ist der Anker gut.", "language"), ("我们发现河流能够改变城市的结果。", "language"),
        ("The rope of the anchor is measured before the winch is used. There is a strong rope between the", "truncated"), ("We find that the rope is long. It uses:\n```\nfor x in", "truncated"),
        ("The rope is long. There are three reasons:\n1) old rope;\n2) new winch;", "truncated"), ("The rope is not used with the winch. The winch is made by the same rule, i.e.", "truncated"),
    ],
)
def test_defects(model, answer, want):
    assert p1.defect(QUESTION, answer, model, COMMON)[0] == want


def test_defined_results(spark):
    words = spark.createDataFrame([(a, w, 1) for w, at in COMMON.items() for a in at], "lang string, word string, rank_no int")
    rows = [(1, None, "The rope of the anchor is not long.", "x"), (2, QUESTION, None, "x"), (3, " ", "", "x"), (4, QUESTION, "The rope of the anchor is long. " * 3000, "x"), (4, QUESTION, "The rope of the anchor is long. " * 3000, "y")]
    df = spark.createDataFrame(rows, "record_id long, question string, answer string, defect string")
    got = {r.record_id: r.defect for r in p1.defects(df, "record_id", "question", "answer", words).collect()}
    assert got == {1: None, 2: "empty", 3: "empty", 4: None}
    assert p1.defects(df.limit(0), "record_id", "question", "answer", words).count() == 0


#: None of these is a form of the grammar.
REFUSALS = (
    "I have no idea.", "That is beyond my knowledge.", "Nothing in the supplied text addresses this.", "My guidelines forbid replying to that.", "I'm afraid I don't have an answer to that.", "Sorry, this isn't something I can speak to.", "The given documents are silent about it.",
    "I wouldn't know.", "No information about this could be found in the excerpts.", "I am not in a position to tell.", "It is impossible to say from the provided passages.", "My policy prohibits me from commenting.", "I haven't got a clue.", "The retrieved text provides no answer to your question.",
    "Unfortunately, I lack the information to respond.", "I refuse to answer.", "There is nothing about this in the sources.", "Ich habe dazu keine Informationen.", "Je n'ai aucune idée.", "No tengo información sobre esto.",
)
SOUND = (
    "The winch of Kelmor has no rope beyond the anchor.", "Nothing but the weight of the rope.", "The rules of the harbour forbid a second winch.", "It isn't the anchor but the rope that gives way first.", "The anchor cannot hold without a chain.", "Ships avoid the route, as no signal reaches it.", "The answer lies in the weight of the winch.",
    "Neither the rope nor the winch, only the tide.", "I measured the rope, and it was too short for the winch.", "The crew do not know the route before the tide turns.", "My guess is the tide, since the winch is strong enough.", "Its policy allows only one ship at a time.", "The text of the treaty limits each ship to one anchor.", "No", "Not much", "About twelve metres of chain",
)


def test_refusals_in_other_words(model):
    missed = [t for t in REFUSALS if p1.defect(QUESTION, t, model, COMMON)[0] != "refusal"]
    assert len(missed) <= 2, missed


def test_sound_answers_with_like_words(model):
    wrong = [t for t in SOUND if p1.defect(QUESTION, t, model, COMMON)[0] is not None]
    assert len(wrong) <= 1, wrong


@pytest.mark.parametrize("answer", ["The parser is limited by", "The rope is used by the", "It depends on whether the"])
def test_a_clause_alone_can_be_cut(model, answer):
    assert p1.defect(QUESTION, answer, model, COMMON)[0] == "truncated"
