import random

from scholaspark.llm import p09_leaks as p9
from scholaspark.llm.common import WORD


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randrange(99)}"
        elif kind == 1:
            words.insert(at, f"new{rng.randrange(99)}")
        else:
            del words[at]
    return words


def setting(seed, edits, size=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.randint(5, 40))] for i in range(60)}
    docs = {}
    for d in range(size):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.6:
            item = items[rng.randrange(60)]
            part = edited(rng, item[: rng.randint(10, 40)], edits)
            at = rng.randint(0, len(words))
            words[at:at] = part
        docs[d] = " ".join(w.upper() + rng.choice(["", ",", ".", "\n"]) for w in words)
    return docs, {i: " - ".join(w) for i, w in items.items()}


def brute(docs, items, edits):
    found = set()
    grams = {i: [w[k : k + 13] for w in [WORD.findall(t.lower())] for k in range(len(w) - 12)] for i, t in items.items()}
    for d, t in docs.items():
        words = WORD.findall((t or "").lower())
        windows = [words[k : k + 13] for k in range(len(words) - 12)]
        for i, own in grams.items():
            if any(p9.edit_distance(a, b, edits) <= edits for a in windows for b in own if edits or a[0] == b[0]):
                found.add((i, d))
    return found


def test_exact_matches_are_complete(spark):
    docs, items = setting(1, 0)
    d, q = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "question_id long, text string")
    got = p9.leaks(d, "doc_id", "text", q, "question_id", "text").where("distance = 0").collect()
    want = brute(docs, items, 0)
    assert want and {(r.item_id, r.doc_id) for r in got} == want


def test_many_items_give_the_same(spark, monkeypatch):
    docs, items = setting(2, 1)
    d, q = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "question_id long, text string")
    small = {tuple(r) for r in p9.leaks(d, "doc_id", "text", q, "question_id", "text").collect()}
    monkeypatch.setattr(p9, "BLOCK_WINDOWS", 100)
    large = {tuple(r) for r in p9.leaks(d, "doc_id", "text", q, "question_id", "text").collect()}
    assert small and large == small
    assert {(i, d) for i, d, far, _ in large if far == 0} == brute(docs, items, 0)


def test_recall_of_edited_passages():
    docs, items = setting(3, 1, 60)
    block = p9.ItemBlock(sorted(items.items()))
    ids, texts = list(docs), list(docs.values())
    got = {(block.lists[i][0], ids[t]) for t, i in block.matches(texts, p9.EDITS)}
    want = brute(docs, items, p9.EDITS)
    assert got <= want
    assert len(got) >= 0.9 * len(want)


def test_recall_of_single_windows_by_edits():
    """Items of exactly one window, so that each case has the fewest chances."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    for edits in (1, 2):
        items, texts = {}, []
        while len(items) < 1200:
            item = [rng.choice(vocabulary) for _ in range(p9.WORDS)]
            around = [rng.choice(vocabulary) for _ in range(8)]
            text = around[:4] + edited(rng, item, edits) + around[4:]
            if any(p9.edit_distance(text[k : k + p9.WORDS], item, p9.EDITS) <= p9.EDITS for k in range(len(text) - p9.WORDS + 1)):
                items[len(items)] = " ".join(item)
                texts.append(" ".join(text))
        block = p9.ItemBlock(sorted(items.items()))
        found = block.matches(texts, p9.EDITS)
        assert sum((i, i) in found for i in items) >= 0.9 * len(items)


def test_windows_that_are_not_embedded_are_no_match():
    docs, items = setting(5, 2, 80)
    block = p9.ItemBlock(sorted(items.items()))
    known = p9.bit_map(block.known)
    texts = list(docs.values())
    found, owner = p9.symbols(texts)
    kept = set(p9.survivors(found, owner, p9.WORDS, p9.EDITS, known).tolist())
    words = [w for t in texts for w in WORD.findall(t.lower())]
    own = [w[k : k + p9.WORDS] for _, w in block.lists for k in range(len(w) - p9.WORDS + 1)]
    for at in p9._starts(owner, p9.WORDS).tolist():
        if at not in kept:
            assert all(p9.edit_distance(words[at : at + p9.WORDS], w, p9.EDITS) > p9.EDITS for w in own)


def test_defined_results(spark):
    d = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a b c", 5), (3, "a b c", 5)], "doc_id long, text string, item_id int")
    q = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (4, "x " * 20)], "question_id long, text string")
    assert p9.leaks(d, "doc_id", "text", q, "question_id", "text").count() == 0
    assert p9.leaks(d.limit(0), "doc_id", "text", q.limit(0), "question_id", "text").count() == 0
