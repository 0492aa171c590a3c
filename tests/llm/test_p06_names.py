import random
from itertools import combinations

import pytest

from scholaspark.llm import p06_names as p6
from scholaspark.llm.common import components

PEOPLE = ["Gregory Lolapenor", "Priya Lolapenor", "William Sokansedin", "Zoë Pafikuntar", "Maria Donmansokos-Bekondan", "Theodore Kanfunfales"]


def variants(name):
    given, family = name.split(" ")
    return [name, f"{family}, {given}", f"{family.upper()} {given}", f"Dr. {given} {family}", name.lower(), f"{given} K. {family}", p6.folded(name), f"{given} {family[:4]}{family[5:]}"]


def test_against_the_known_classes(spark):
    names = {n: v for n in PEOPLE for v in [n] for n in variants(v)}
    names |= {"G. Lolapenor": PEOPLE[0], "Lolapenor, P.": PEOPLE[1], "Bill Sokansedin": PEOPLE[2]}
    bodies = {"University of Todontimen": "u", "Univ. of Todontimen": "u", "Todontimen Univ": "u", "UNIVERSITY OF TODONTIMEN": "u", "Todontimen Transport Authority": "t", "Institute of Technolgy, Dobora": "d", "Dobora Inst. of Tech.": "d", "Institute of Technology Fundamonven": "f", "Fundamonvrn Inst. of Tech.": "f"}
    papers = spark.createDataFrame([([n, "", None, " "],) for n in names] + [(None,)], "authors array<string>")
    entities = spark.createDataFrame([([(n, " Organisation "), ("Gregory Lolapenor", "method")],) for n in bodies] + [([("Todontimen Univ", "Person")],), (None,)], "entities array<struct<name string, entity_type string>>")
    nicks = spark.createDataFrame([("William", "Bill"), (None, "x")], "given string, nick string")
    rows = p6.linked(papers, entities, nicks).collect()
    label = {r.name: r.label for r in rows}
    truth = names | bodies
    got = {(a, b) for a, b in combinations(sorted(label), 2) if label[a] == label[b]}
    want = {(a, b) for a, b in combinations(sorted(truth), 2) if truth[a] == truth[b]}
    assert got == want


def test_ambiguous_initial_joins_none(spark):
    papers = spark.createDataFrame([(["Peter Lolapenor", "Priya Lolapenor", "P. Lolapenor", "Dr. Priya Lolapenor"],)], "authors array<string>")
    none = spark.createDataFrame([], "entities array<struct<name string, entity_type string>>")
    rows = p6.linked(papers, none, spark.createDataFrame([], "given string, nick string")).collect()
    assert {r.name for r in rows} == {"Priya Lolapenor", "Dr. Priya Lolapenor"}


@pytest.mark.parametrize("seed", range(20))
def test_string_measures(seed):
    rng = random.Random(seed)
    a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in "ab")
    table = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            table[i, j] = 0 if not i or not j else table[i - 1, j - 1] + 1 if a[i - 1] == b[j - 1] else max(table[i - 1, j], table[i, j - 1])
    assert p6.lcs(a, b) == table[len(a), len(b)]
    assert p6.edits(a, b, 20) <= len(a) + len(b) - 2 * p6.lcs(a, b)


def test_common_suffixes_are_refined(spark):
    rng = random.Random(4)
    stems = {"".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(60)}
    names = [f"Margaret {s.title()}menor" for s in sorted(stems)]
    typos = [n[:-3] + n[-2] + n[-3] + n[-1] for n in names]
    parsed = p6.read(spark.createDataFrame([(n, "p") for n in names + typos], "name string, kind string"))
    pairs = {(r.a[1:], r.b[1:]) for r in p6.candidates(parsed, common=10).collect()}
    assert sum(tuple(sorted(x)) in pairs for x in zip(names, typos)) >= 0.95 * len(names)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(70)] + [("x", "y"), ("z", "z"), (None, "q")], "a string, b string")
    rows = components(edges).collect()
    assert {r.label for r in rows if r.node.startswith("n")} == {"n000"} and {(r.node, r.label) for r in rows if r.node in "xyzq"} == {("x", "x"), ("y", "x")}
    assert components(edges.limit(0)).count() == 0


def spelled(rng, n):
    """Names with slips, initials, short forms and short or long families."""
    syllable = lambda: rng.choice("bdklmnrst") + rng.choice("aeiou")
    families = ["Li", "Wu", "Ng", "Smith", "Smyth", "Oe"] + ["".join(syllable() for _ in range(rng.choice((2, 3, 4, 5, 9, 11)))).title() for _ in range(12)]
    givens = ["Wei", "Bo", "Yohan", "Johan", "William", "Bill", "Elizabeth", "Beth", "Joerg", "Jorg", "Al"]
    found = set()
    while len(found) < n:
        family, given = rng.choice(families), rng.choice(givens)
        for _ in range(rng.choice((0, 0, 0, 1, 2, 3))):
            i = rng.randrange(len(family))
            family = rng.choice([family[:i] + rng.choice("aeinr") + family[i + 1 :], family[:i] + family[i + 1 :] or family, family[:i] + family[i:][1::-1] + family[i + 2 :], family[:i] + "n" + family[i:]])
        found.add(rng.choice([f"{given} {family}", f"{family}, {given}", f"{given[0]}. {family}", f"{given[:3]}. {family}", f"{given} K. {family}", family]))
    return sorted(found)


@pytest.mark.parametrize("common", [3, 1000])
def test_every_linked_pair_is_a_candidate(spark, common):
    rng = random.Random(7)
    names = [(n, "p") for n in spelled(rng, 500)] + [(f"{w} {n.split()[-1]}", "o") for n, w in zip(spelled(rng, 80), ["University of", "Univ.", "Institute of Technology", ""] * 20)]
    parsed = p6.read(spark.createDataFrame(sorted(set(names)), "name string, kind string")).cache()
    formal = {"bill": frozenset(("bill", "william")), "william": frozenset(("william",))}
    learned = spark.createDataFrame([("al", "wei")], "item_a string, item_b string")
    rows = [(r.kind + r.name, r.kind, (r.family, r.given, r.form, r.initials)) for r in parsed.collect()]
    want = set()
    for x, y in combinations(sorted(rows), 2):
        if x[1] == y[1] and p6.link(x[1], x[2], y[2], formal, {x[2][1], y[2][1]} == {"al", "wei"}):
            want.add((x[0], y[0]))
    got = {(r.a, r.b) for r in p6.candidates(parsed, common, formal, learned).collect()}
    assert not want - got and len(want) > 100


def test_crowded_family_and_initial_are_compared(spark):
    names = ["J. Smith", "Smith, J."] + [f"J{a}{b}n Smith" for a in "aeiou" for b in "bcdfghjklmnpqrstvwxyz"]
    parsed = p6.read(spark.createDataFrame([(n, "p") for n in names], "name string, kind string"))
    pairs = {(r.a[1:], r.b[1:]) for r in p6.candidates(parsed).collect()}
    assert all(tuple(sorted(("J. Smith", n))) in pairs for n in names[1:])


def test_short_names_meet(spark):
    parsed = p6.read(spark.createDataFrame([(n, "p") for n in ("W. Li", "Wei Li", "Bo Li", "Li, Bo", "Ng, A.", "Al Ng")], "name string, kind string"))
    pairs = {(r.a[1:], r.b[1:]) for r in p6.candidates(parsed).collect()}
    assert {("W. Li", "Wei Li"), ("Bo Li", "Li, Bo"), ("Al Ng", "Ng, A.")} <= pairs
