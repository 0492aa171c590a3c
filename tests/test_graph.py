import random

import pytest
from pyspark.sql import functions as F

from scholaspark.operators import communities as CO
from scholaspark.operators import graph as G
from scholaspark.operators import visual as VI
from scholaspark.sources.files import EXTRACTION



def order():
    return [F.col("n")]


SCHEMA = EXTRACTION + ", n int, node_id string"


def sample(spark):
    rows = [
        ("c1", [("PPO ", "Algorithm", "first"), ("ppo", "Method", "second"), (None, None, None), (" ", "x", "y")], [("PPO", "RL", "part_of", "d1", "c1"), ("", "RL", "x", "", "c1")], "ok", 1, "z"),
        ("c2", [("RL\x00", "Concept", None)], [("ppo", "rl", "uses", "d2", "c2"), ("RL", "Go", "x", None, None), ("Loop", "loop", "self", "", "c2")], "predicted_overflow", 2, "z"),
        ("c3", None, None, None, 3, "z"),
        ("c4", [], [("Go", "Chess", None, None, "c4")], "fallback_success", 4, "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_first_mention_wins(spark):
    got = {r.node_id: (r.label, r.entity_type, r.description) for r in G.nodes(sample(spark), order()).collect()}
    assert got == {"ppo": ("PPO", "Algorithm", "first"), "rl": ("RL", "Concept", ""), "go": ("Go", "UNKNOWN", None), "loop": ("Loop", "UNKNOWN", None), "chess": ("Chess", "UNKNOWN", None)}


def test_edges(spark):
    got = {(r.src, r.dst): (r.relation_type, r.description, r.weight, r.chunk_ids) for r in G.edges(sample(spark), order()).collect()}
    assert got[("ppo", "rl")] == ("part_of", "d1", 2, ["c1", "c2"]) and got[("rl", "go")] == ("x", "", 1, []) and len(got) == 4
    weights = {(r.src, r.dst): (r.weight, r.n_chunks) for r in G.edge_weights(sample(spark), order()).collect()}
    assert weights == {k: (v[2], len(v[3])) for k, v in got.items()}
    assert G.edges(G.good_only(sample(spark)), order()).count() == 2
    assert G.edges(sample(spark).limit(0), order()).count() == 0 and G.nodes(sample(spark).limit(0), order()).count() == 0


def test_degrees_and_neighbours(spark):
    n, e = G.nodes(sample(spark), order()), G.edges(sample(spark), order())
    assert {r.node_id: r.degree for r in G.degrees(n, e).collect()} == {"ppo": 1, "rl": 2, "go": 2, "chess": 1, "loop": 2}
    assert [r.node_id for r in G.top_entities(n, e, 2).collect()] == ["go", "loop"]
    for hops, want in ((0, {"ppo"}), (1, {"ppo", "rl"}), (2, {"ppo", "rl", "go"}), (9, {"ppo", "rl", "go", "chess"})):
        assert {r.node_id for r in G.neighbours(e, n, " PPO ", hops).collect()} == want
    assert G.neighbours(e, n, "nobody").count() == 0 and G.entity_info(n, "RL").first().label == "RL"
    lines = G.context_lines(spark.createDataFrame([(1, "ppo"), (1, "rl"), (2, "rl")], "q int, node_id string"), n, e, ["q"])
    assert [(r.q, r.line) for r in lines.collect()] == [(1, "PPO --[part_of]--> RL")]
    assert {r.node_id for r in G.chunk_entities(sample(spark), order()).where("chunk_id = 'c2'").collect()} == {"ppo", "rl", "loop"}


def tables(spark, pairs, extra=()):
    names = sorted({x for p in pairs for x in p} | set(extra))
    nodes = spark.createDataFrame([(x, x.upper(), "T", None) for x in names], "node_id string, label string, entity_type string, description string")
    edges = spark.createDataFrame([(a, b, "r", None, 1, ["c"]) for a, b in pairs], "src string, dst string, relation_type string, description string, weight long, chunk_ids array<string>")
    return nodes, edges


@pytest.mark.parametrize("seed", range(2))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(40)]
    nodes, edges = tables(spark, pairs, ["alone"])
    parent = {r.node_id: r.node_id for r in nodes.collect()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert {r.node_id: r.component for r in CO.connected_components(nodes, edges).collect()} == {x: find(x) for x in parent}


def two_groups(spark):
    left, right = [f"a{i}" for i in range(6)], [f"b{i}" for i in range(5)]
    pairs = [(x, y) for g in (left, right) for x in g for y in g if x < y] + [("a0", "b0")]
    return tables(spark, pairs, ["zz"])


def test_communities(spark):
    nodes, edges = two_groups(spark)
    members = CO.detect(nodes, edges)
    got = {r.node_id: r.community for r in members.collect()}
    assert {got[f"a{i}"] for i in range(6)} == {0} and {got[f"b{i}"] for i in range(5)} == {1} and got["zz"] == 2
    # By hand: m = 26, 15 and 10 edges within, degrees 31 and 21.
    assert CO.modularity(members, edges).first().modularity == pytest.approx(25 / 26 - (31 / 52) ** 2 - (21 / 52) ** 2)
    table = {r.community_id: r for r in CO.community_table(members, CO.summarise(members, nodes, edges)).collect()}
    assert table[0].size == 6 and table[0].summary == "A community of 6 entities around A0, A1, A2, A3, A4." and table[2].nodes == ["zz"]
    assert CO.has_summaries(CO.community_table(members)) is False
    assert CO.facts(members, nodes, edges).where("kind = 'relation'").count() == 25
    assert CO.detect(nodes.limit(0), edges.limit(0)).count() == 0


def test_sample_takes_turns(spark):
    nodes, edges = two_groups(spark)
    members = spark.createDataFrame([(f"a{i}", 0) for i in range(6)] + [(f"b{i}", 1) for i in range(5)], "node_id string, community int")
    got = [r.node_id for r in VI.sample(nodes, edges, members, 5).orderBy("place").collect()]
    assert got == ["a0", "b0", "a1", "b1", "a2"]
    assert VI.sample(nodes, edges, members, 50).count() == 12


def test_artifacts(spark, tmp_path):
    nodes, edges = two_groups(spark)
    found = VI.artifacts(nodes, edges)
    assert set(found) == {"entities", "relationships", "communities", "community_reports", "documents", "text_units", "covariates"}
    assert [r.human_readable_id for r in found["entities"].orderBy("id").collect()] == list(range(1, 13))
    assert {r.size for r in found["communities"].collect()} == {11, 1}
    assert found["relationships"].where("source = 'a0' and target = 'b0'").first().text_unit_ids == '["c"]'
    paths = VI.write_artifacts(nodes, edges, str(tmp_path), True)
    assert len(paths) == 7 and spark.read.parquet(f"{tmp_path}/create_final_entities.parquet").count() == 12
    page = VI.write_html(nodes, edges, CO.detect(nodes, edges), str(tmp_path / "g.html"), 4)
    assert open(page).read().count("<circle") == 4
