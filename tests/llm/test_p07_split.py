import hashlib
import random
from itertools import pairwise

import pytest

from scholaspark.llm import p07_split as p7


def best_by_trying(text, limit, overlap):
    """The least cost over all ways to choose cuts among the candidates."""
    at, cost = p7.candidates(text)
    begins = [0] + [p7.begin_of(text, c, overlap) for c in at[1:-1]]
    count = -(-(len(text) - overlap) // (limit - overlap))
    mean = (len(text) + overlap * (count - 1)) / count

    def least(j):
        if j == 0:
            return 0.0
        return min((least(i) + ((at[j] - begins[i]) / mean - 1) ** 2 + cost[j] for i in range(j) if at[j] - begins[i] <= limit), default=float("inf"))

    return least(len(at) - 1)


def cost_of(text, cuts, limit, overlap):
    at, cost = p7.candidates(text)
    penalty = dict(zip(at, cost))
    count = -(-(len(text) - overlap) // (limit - overlap))
    mean = (len(text) + overlap * (count - 1)) / count
    return sum(((b - a) / mean - 1) ** 2 + penalty[b] for a, b in cuts)


@pytest.mark.parametrize("seed", range(12))
def test_optimal_whole_and_within_the_limit(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["alpha", "be", ". ", ", ", "\n\n", "\n", " ", " ", "x" * rng.randint(1, 30), "中。"]) for _ in range(320))
    limit, overlap = 600, 60
    cuts = p7.split(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (a, b), (c, d) in pairwise(cuts):
        assert b - overlap <= c <= b < d and a < c
    assert all(b - a <= limit for a, b in cuts)
    if len(p7.candidates(text)[0]) < 16:
        assert cost_of(text, cuts, limit, overlap) == pytest.approx(best_by_trying(text, limit, overlap))


def test_no_boundary_at_all():
    cuts = p7.split("x" * 9000)
    assert all(b - a <= 2000 for a, b in cuts) and cuts[-1][1] == 9000
    assert [c for c, _ in cuts[1:]] == [b - 200 for _, b in cuts[:-1]]


def test_few_candidates_are_optimal():
    text = ("s" * 200 + ". ") * 6
    assert cost_of(text, p7.split(text, 600, 60), 600, 60) == pytest.approx(best_by_trying(text, 600, 60))


def test_defined_results(spark):
    rows = [("a", None, 1), ("b", "", 1), ("c", "w " * 1000, 1), ("d", "w " * 1001, 1), ("d", "w " * 1001, 2), ("e", " " * 5000, 1)]
    df = spark.createDataFrame(rows, "k string, text string, index int")
    found = p7.split_texts(df, "k", "text")
    assert {r.item_key for r in found.collect()} == {"d", "e"}
    assert found.where("item_key = 'd'").count() == 4
    assert p7.split_texts(df.limit(0), "k", "text").count() == 0


@pytest.mark.parametrize(("limit", "overlap"), [(200, 0), (1, 0), (2, 1), (50, 49), (240, 0), (300, 200), (700, 690)])
def test_any_limit_and_overlap(limit, overlap):
    rng = random.Random(limit + overlap)
    text = "".join(rng.choice(["alpha", "be", ". ", ", ", "\n\n", "\n", " ", "x" * rng.randint(1, 400), "中。"]) for _ in range(60))
    cuts = p7.split(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(0 < b - a <= limit for a, b in cuts)
    for (_, b), (c, d) in pairwise(cuts):
        assert b - overlap <= c <= b < d
    with pytest.raises(ValueError):
        p7.split(text, limit, limit)


def test_pieces_give_the_text_again(spark):
    rng = random.Random(1)
    rows = [(str(i), "".join(rng.choice(["alpha ", "be. ", "\n", "中。", "\U0001f600"]) for _ in range(n))) for i, n in enumerate((0, 10, 900, 5000, 1500))] + [("n", None)]
    df = spark.createDataFrame(rows, "k string, text string")
    got = {r.item_key: r for r in p7.rebuilt(p7.split_texts(df, "k", "text"), ["item_key"]).collect()}
    want = {k: hashlib.md5(t.encode()).hexdigest() for k, t in rows if t and len(t) > p7.LIMIT}
    assert {k: r.digest for k, r in got.items()} == want and all(r.longest <= p7.LIMIT and r.overlap <= p7.OVERLAP for r in got.values())
