import random
from collections import Counter
from itertools import combinations

from scholaspark.llm import p04_pairs as p4

SCHEMA = "chunk_id string, entities array<struct<name string>>, relations array<struct<source string, target string>>, item int"


def rows(seed=1, n=300):
    rng = random.Random(seed)
    found = []
    for i in range(n):
        names = [f"Item  {int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randint(0, 8))] + (["Hot"] if rng.random() < 0.3 else [])
        if rng.random() < 0.15:
            names += [" rare a", "Rare\tB "]
        entities = [(x,) for x in names[::2]] + [(None,), ("  ",)] if rng.random() < 0.9 else None
        relations = [(x, None) for x in names[1::2]] if rng.random() < 0.9 else []
        found.append((f"c{i // 2 if i % 7 == 0 else i}", entities, relations, 1))
    return found


def brute(data, least, lift):
    baskets = {}
    for c, e, r, _ in data:
        names = [x[0] for x in e or []] + [y for x in r or [] for y in x]
        baskets.setdefault(c, set()).update(" ".join(x.lower().split()) for x in names if x and x.strip())
    baskets = {c: b for c, b in baskets.items() if b}
    single, both = Counter(), Counter()
    for b in baskets.values():
        single.update(b)
        both.update(combinations(sorted(b), 2))
    return {(a, b, single[a], single[b], n) for (a, b), n in both.items() if n >= least and n * len(baskets) >= lift * single[a] * single[b]}


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    for entries, items in ((10**6, 10**6), (200, 10), (200, 25), (50, 3), (10, 1)):
        for lift in (1, 2):
            got = p4.together(p4.entries(df), 3, lift, entries, items).collect()
            assert {(r.item_a, r.item_b, r.n_a, r.n_b, r.n_ab) for r in got} == brute(data, 3, lift)


def test_defined_results(spark):
    df = spark.createDataFrame([("a", None, None, 1), (None, [("x",)], [], 1)], SCHEMA)
    assert p4.together(p4.entries(df)).count() == 0
    assert p4.together(p4.entries(df.limit(0))).count() == 0


def test_a_large_basket_is_shared_out(spark):
    data = [(f"c{i}", [(f"item {j}",) for j in range(600 if i < 6 else 3)], [], 1) for i in range(60)]
    df = spark.createDataFrame(data, SCHEMA)
    entries = p4.entries(df)
    got = p4.together(entries, 5, 8, 20_000, 100).collect()
    assert len(got) == 597 * 596 // 2 and all(r.n_ab == 6 for r in got)
