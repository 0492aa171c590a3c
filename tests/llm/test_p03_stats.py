import random

import numpy as np
import pytest

from scholaspark.llm import p03_stats as p3

WORDS = [("en", w) for w in "the of and a in to is for that on with by are we be this it as not was had but no".split()] + [("de", w) for w in "das der die und ist mit wir nicht auf dem".split()]


class Row:
    def __init__(self, lang, word):
        self.lang, self.word = lang, word


COMMON = p3.common_words([Row(*w) for w in WORDS])


def sample(kind, rng):
    noun = lambda: rng.choice(["stone", "house", "garden", "wire", "paper", "lamp", "road"])
    n = rng.randint(5, 14)
    if kind == "prose":
        return " ".join(f"The {noun()} of the {noun()} was not in the {noun()}, but we had a {noun()} with it." for _ in range(n))
    if kind == "list":
        return "\n".join(f"{i + 1}. old {noun()} and {noun()}" for i in range(n))
    if kind == "table":
        return "\n".join(f"{noun()}\t{rng.random() * 50:.1f}\t{rng.randint(1, 99)}\t{rng.random():.2f}" for _ in range(n))
    return "".join(rng.choice("%&/()=?#+*~<>|^ ") for _ in range(n * 20))


def test_held_out_accuracy():
    rng = random.Random(2)
    rows = [(k, sample(k, rng)) for k in p3.KINDS for _ in range(40)]
    model = p3.Profiles(rows[::2], COMMON)
    held = rows[1::2]
    got = [k for _, k, _ in p3.classify([t for _, t in held], model)]
    assert sum(a == b for a, (b, _) in zip(got, held)) >= 0.97 * len(held)


def test_divergence_bounds():
    p, q = np.array([0.5, 0.5, 0.0, 0.0]), np.array([[0.5, 0.5, 0, 0], [0, 0, 0.5, 0.5]])
    assert p3.divergence(p, q)[0] == pytest.approx([0.0, 1.0], abs=1e-5)


def test_mixture_votes_by_size():
    rng = random.Random(5)
    model = p3.Profiles([], COMMON)
    junk = "\n".join(sample("junk", rng) for _ in range(12))
    assert p3.classify([junk + "\n" + sample("prose", random.Random(1))[:60]], model)[0][1] == "junk"


def test_majority_of_segments_overrules_the_whole_text():
    rng = random.Random(0)
    model = p3.Profiles([], COMMON)
    text = "\n\n".join(sample(k, rng) for k in ["prose"] * 3 + ["list"] * 3)
    counts = p3.describe(text, COMMON)[1]
    (kind, d), = model.nearest(np.array([p3.normalised(counts)]))
    assert kind == "list" and d > 0.1
    assert p3.classify([text], model)[0][1] == "prose"


def test_defined_results(spark):
    rows = [("a", None, 1), ("b", "", 1), ("c", " \n", 1), ("d", "The end was not in the house, but we had a lamp. " * 4, 1), ("d", "The end was not in the house, but we had a lamp. " * 4, 2), ("e", "%&/ ( )=? " * 200000, 3)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, kind int")
    got = {r.chunk_id: r for r in p3.statistics(df, "chunk_id", "text", p3.Profiles([], COMMON)).collect()}
    assert [got[k].kind for k in "abc"] == [None] * 3 and got["b"].n_words == 0
    assert got["d"].kind == "prose" and got["d"].n_words == 48 and got["e"].kind == "junk"
    assert p3.statistics(df.limit(0), "chunk_id", "text", p3.Profiles([], COMMON)).count() == 0
