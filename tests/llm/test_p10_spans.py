import random

import numpy as np

from scholaspark.llm import p10_spans as p10


def brute(texts, span):
    grams, pairs = {}, set()
    for i, t in texts.items():
        for g in {t[k : k + span] for k in range(len(t or "") - span + 1)}:
            grams.setdefault(g, []).append(i)
    for ids in grams.values():
        pairs |= {(min(a, b), max(a, b)) for a in ids for b in ids if a != b}
    return pairs


def brute_share(texts, span):
    found = {}
    for i, t in texts.items():
        t = t or ""
        others = {o[k : k + span] for j, o in texts.items() if j != i and o for k in range(len(o) - span + 1)}
        hit = np.zeros(len(t), bool)
        for k in range(len(t) - span + 1):
            if t[k : k + span] in others:
                hit[k : k + span] = True
        found[i] = int(hit.sum())
    return found


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh \U0001f600é") for _ in range(rng.randint(0, 90)))
    shared = ["".join(rng.choice("ijklmn op") for _ in range(s)) for s in (39, 40, 41, 60, 120, 200)] + ["ab" * 50, "z" * 80]
    texts = {}
    for i in range(n):
        parts = [word()]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            cut = rng.randint(0, max(0, len(s) - 38))
            parts += [s[cut:], word()]
        texts[i] = "".join(parts)
    texts[n], texts[n + 1] = None, ""
    return texts


def test_against_brute_force_in_batches(spark):
    for seed in range(3):
        texts = corpus(seed)
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        batches = [df.where("doc_id < 20"), df.where("doc_id between 20 and 30"), df.where("doc_id > 30")]
        index = p10.indexed(df, "doc_id", "text", batches, min_span=40, window=25)
        assert {(r.id_a, r.id_b) for r in index.matches(df, "doc_id", "text").collect()} == brute(texts, 40)
        rows = {r.item_id: r.shared_chars for r in p10.shares(index.covered(df, "doc_id", "text"), df, "doc_id", "text").collect()}
        assert rows == brute_share(texts, 40)


def test_stretches_that_repeat_themselves(spark):
    rng = random.Random(4)
    for period in (1, 2, 7, 24, 25, 26, 31):
        unit = "".join(rng.choice("abcdefghijklmnop") for _ in range(period))
        letters = lambda n: "".join(rng.choice("qrstuvwxyz") for _ in range(n))
        texts = {i: letters(rng.randint(0, 30)) + (unit * 300)[rng.randint(0, period) :][: rng.choice([20, 39, 40, 45, 90, 300])] + letters(rng.randint(0, 30)) for i in range(12)}
        texts[12] = texts[13] = unit * 12 + "-" + unit * 5
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        index = p10.indexed(df, "doc_id", "text", None, min_span=40, window=25)
        assert {(r.id_a, r.id_b) for r in index.matches(df, "doc_id", "text").collect()} == brute(texts, 40)
        rows = {r.item_id: r.shared_chars for r in p10.shares(index.covered(df, "doc_id", "text"), df, "doc_id", "text").collect()}
        assert rows == brute_share(texts, 40)


def test_a_long_stretch_of_production_size(spark):
    df = spark.createDataFrame([(1, "abcdefghij" * 600), (2, "abcdefghij" * 600), (3, "abcdefghij" * 59)], "doc_id long, text string")
    index = p10.indexed(df, "doc_id", "text")
    assert [(r.id_a, r.id_b) for r in index.matches(df, "doc_id", "text").collect()] == [(1, 2)]
    rows = p10.shares(index.covered(df, "doc_id", "text"), df, "doc_id", "text").collect()
    assert {r.item_id: (r.shared_chars, r.share) for r in rows} == {1: (6000, 1.0), 2: (6000, 1.0), 3: (0, 0.0)}


def test_a_later_session_joins_history(spark, tmp_path):
    texts = corpus(5)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    folder = str(tmp_path / "index")
    first = p10.SpanIndex(spark, 40, 25, folder=folder)
    first.add(df.where("doc_id < 20"), "doc_id", "text")
    first.close()
    later = p10.SpanIndex.open(spark.newSession(), folder)
    later.add(df.where("doc_id >= 20"), "doc_id", "text")
    assert {(r.id_a, r.id_b) for r in later.matches(df, "doc_id", "text").collect()} == brute(texts, 40)
    later.close()
    assert len(p10.SpanIndex.open(spark, folder).shared) == 2


def test_holders_meet_in_slices(spark, monkeypatch):
    monkeypatch.setattr(p10, "SLICE", 2)
    monkeypatch.setattr(p10, "HOT", 3)
    texts = corpus(6)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {(r.id_a, r.id_b) for r in p10.span_matches(df, "doc_id", "text", None, 40, 25).collect()} == brute(texts, 40)


def test_hot_hashes_are_refined(spark, monkeypatch):
    monkeypatch.setattr(p10, "HOT", 3)
    texts = corpus(9)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = p10.span_matches(df, "doc_id", "text", None, min_span=40, window=25)
    assert {(r.id_a, r.id_b) for r in found.collect()} == brute(texts, 40)


def test_defined_results(spark):
    df = spark.createDataFrame([(1, "x" * 700, 1), (1, "x" * 700, 2), (2, None, 3)], "doc_id long, text string, hash int")
    assert p10.span_matches(df, "doc_id", "text").count() == 0
    assert p10.span_matches(df.limit(0), "doc_id", "text").count() == 0
    assert {(r.item_id, r.share) for r in p10.shares(p10.indexed(df, "doc_id", "text").covered(df, "doc_id", "text"), df, "doc_id", "text").collect()} == {(1, 0.0), (2, 0.0)}


def test_winnow_keeps_the_least_of_every_stretch():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 50, 500).astype(np.uint64)
    kept = set(p10.winnow(h, 7).tolist())
    for s in range(len(h) - 6):
        assert {i for i in range(s, s + 7) if h[i] == h[s : s + 7].min()} & kept
