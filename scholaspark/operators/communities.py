"""Communities of the graph: detection, quality, summaries, connected parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholaspark.functions.text import strip
from scholaspark.lineage import cut
from scholaspark.lineage import numbered as in_order
from scholaspark.operators.models import Model, replies


def undirected(edge_table: DataFrame) -> DataFrame:
    """(a, b, w), a <= b: the edges without direction, one per pair, weight 1."""
    return edge_table.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("w", F.lit(1.0))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of the nodes of the edges: the least node that can be
    reached. Null ends and loops are no edges.

    Every node takes the least label around it, then the label of its label,
    until nothing changes, so the rounds grow with the logarithm of the longest
    path. Only whether anything changed comes to the driver.
    """
    one = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node is not null and other is not null and node <> other")
    both = cut(one.unionByName(one.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")))
    while True:
        near = both.join(labels.toDF("other", "theirs"), "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        jump = labels.toDF("label", "further")
        new = cut(
            labels.join(near, "node", "left")
            .join(jump, "label", "left")
            .select("node", F.col("label").alias("old"), F.least("label", F.coalesce("theirs", "label"), F.coalesce("further", "label")).alias("label"))
        )
        labels = new.select("node", "label")
        if new.where("old <> label").limit(1).count() == 0:
            return labels


def connected_components(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """(node_id, component): the least node_id that can be reached; a node
    without edges is one of its own."""
    found = components(edge_table, "src", "dst").toDF("node_id", "component")
    return node_table.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


#: Least gain of modularity of two half rounds for which the moves go on.
TOLERANCE = 1e-4


def detect(node_table: DataFrame, edge_table: DataFrame, resolution: float = 1.0, tolerance: float = TOLERANCE) -> DataFrame:
    """(node_id, community): communities by local moves of greatest gain.

    In each round every node weighs its neighbours' communities by the gain of
    modularity that moving there brings; half of the nodes (by a hash of node
    and round, so no pair keeps swapping) take the best. When the modularity no
    longer rises, its best labels stand, each community becomes one node of a
    smaller graph, and the moves go on there, until a graph brings no gain.
    Every graph raises the modularity by more than ``tolerance``, so this ends.
    Deterministic; a community is named by a number from 0, larger ones first,
    ties by their least node.
    """
    pair = undirected(edge_table).where("a <> b")
    both = cut(pair.select("a", "b", "w").unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")))
    total = both.agg(F.sum("w")).first()[0] or 0.0
    members = cut(node_table.select("node_id", F.col("node_id").alias("c")))
    while total:
        moved = _moves(both, total, resolution, tolerance)
        if moved is None:
            break
        members = cut(members.join(moved.toDF("c", "to"), "c", "left").select("node_id", F.coalesce("to", "c").alias("c")))
        ends = both.join(moved.toDF("a", "ca"), "a").join(moved.toDF("b", "cb"), "b")
        both = cut(ends.groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
    return numbered(members)


def _moves(both: DataFrame, total: float, resolution: float, tolerance: float) -> DataFrame | None:
    """(node, c) after the local moves on one graph, given as symmetric weights
    (a, b, w) with loops; None if they bring no gain."""
    weight = cut(both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("loop")))
    loops = weight.agg(F.sum("loop")).first()[0] or 0.0
    labels = weight.select("node", F.col("node").alias("c"))
    best, most, number, stale = None, None, 0, 0
    while True:
        links = both.where("a <> b").join(labels.toDF("b", "c"), "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("w").alias("inside"))
        sizes = labels.join(weight, "node").groupBy("c").agg(F.sum("k").alias("tot"))
        own = labels.join(weight, "node").select("node", F.col("c").alias("own"), "k").join(sizes.toDF("own", "own_tot"), "own")
        # The sums of both sides of the modularity come with the moves.
        scored = links.join(own, "node").join(sizes, "c").withColumn("gain", F.col("inside") - F.lit(resolution) * F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / F.lit(total))
        is_own = F.col("c") == F.col("own")
        chosen = scored.groupBy("node").agg(F.max(F.struct("gain", "c")).alias("best"), F.max(F.when(is_own, F.col("gain"))).alias("stay"), F.sum(F.when(is_own, F.col("inside")).otherwise(0.0)).alias("inside"))
        # A node without links to its own community would stay there alone.
        alone = -F.lit(resolution) * F.col("k") * (F.col("own_tot") - F.col("k")) / F.lit(total)
        turn = F.pmod(F.xxhash64("node", F.lit(number)), F.lit(2)) == 0
        goes = turn & (F.col("best.gain") > F.coalesce("stay", alone) + 1e-12)
        new = cut(own.join(chosen, "node", "left").select("node", F.col("own").alias("old"), F.when(goes, F.col("best.c")).otherwise(F.col("own")).alias("c"), F.coalesce("inside", F.lit(0.0)).alias("inside"), (F.col("k") * F.col("own_tot")).alias("expected")))
        sums = new.agg(F.sum("inside").alias("i"), F.sum("expected").alias("e")).first()
        reached = (sums.i + loops) / total - resolution * sums.e / total**2
        if most is None or reached > most + tolerance:
            best, most, stale = (None if most is None else labels), reached, 0
        else:
            stale += 1
            if stale == 2:
                return best
        labels = new.select("node", "c")
        number += 1


def numbered(labels: DataFrame) -> DataFrame:
    """Communities (node_id, c) with numbers in place of names."""
    sizes = labels.groupBy("c").agg(F.count("*").alias("n"), F.min("node_id").alias("least"))
    numbers = in_order(sizes, [F.desc("n"), F.col("least")], "number")
    return labels.join(numbers.select("c", F.col("number").cast("int").alias("community")), "c").select("node_id", "community")


def modularity(membership: DataFrame, edge_table: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity) of a partition; null without edges."""
    pair = undirected(edge_table)
    inside = pair.join(membership.toDF("a", "ca"), "a").join(membership.toDF("b", "cb"), "b")
    total = F.sum("w")
    ends = inside.select(F.explode(F.array("ca", "cb")).alias("community"), "w").groupBy("community").agg(F.sum("w").alias("k"))
    within = inside.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("w").alias("l"))
    m = inside.agg(total.alias("m"))
    rows = ends.join(within, "community", "left").join(F.broadcast(m), F.lit(True))
    part = F.coalesce("l", F.lit(0.0)) / F.col("m") - F.lit(resolution) * F.pow(F.col("k") / (2 * F.col("m")), F.lit(2))
    return rows.agg(F.sum(part).alias("modularity"))


def facts(membership: DataFrame, node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """(community, kind, line, degree): what a summary is written from; the
    degree is that of the entity, or of a relation's source."""
    from scholaspark.operators.graph import degrees

    named = membership.join(node_table, "node_id").join(degrees(node_table, edge_table).select("node_id", "degree"), "node_id")
    entity = named.select("community", F.lit("entity").alias("kind"), F.concat(F.lit("Entity: "), "label", F.lit(" (type: "), F.coalesce("entity_type", F.lit("")), F.lit(")")).alias("line"), "degree")
    a = named.select(F.col("node_id").alias("src"), "community", F.col("label").alias("a"), "degree")
    b = named.select(F.col("node_id").alias("dst"), F.col("community").alias("other"), F.col("label").alias("b"))
    inside = edge_table.select("src", "dst", "relation_type").join(a, "src").join(b, "dst").where("community = other")
    relation = inside.select("community", F.lit("relation").alias("kind"), F.concat(F.lit("Relation: "), "a", F.lit(" --["), F.coalesce("relation_type", F.lit("related_to")), F.lit("]--> "), "b").alias("line"), "degree")
    return entity.unionByName(relation)


def summarise(membership: DataFrame, node_table: DataFrame, edge_table: DataFrame, names: int = 5, limit: int | None = None) -> DataFrame:
    """(community, size, summary): the default summary, made of the members of
    highest degree; of the ``limit`` largest communities if given. A model's
    summary may take its place."""
    from scholaspark.operators.graph import degrees

    sizes = membership.groupBy("community").agg(F.count("*").alias("size"))
    if limit is not None:
        sizes = sizes.orderBy(F.desc("size"), "community").limit(limit)
    ranked = membership.join(degrees(node_table, edge_table), "node_id").join(node_table.select("node_id", "label", "entity_type"), "node_id")
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "node_id"))
    top = ranked.withColumn("rank", rank).where(F.col("rank") <= names)
    lists = top.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]), ", ").alias("names"))
    return sizes.join(lists, "community").select("community", "size", F.concat(F.lit("A community of "), F.col("size").cast("string"), F.lit(" entities around "), "names", F.lit(".")).alias("summary"))


#: Fixed value: how a model is asked for a summary.
SUMMARY_PROMPT = "Summarise in two or three sentences what connects these entities of a knowledge graph.\n\n"
#: Facts of one community that a model is shown at most, those of its best
#: connected members first; no model's context holds more.
SHOWN_FACTS = 200


def summarise_by_model(membership: DataFrame, node_table: DataFrame, edge_table: DataFrame, model: Model, limit: int | None = None) -> DataFrame:
    """(community, size, summary) as a model writes them from the facts; of the
    ``limit`` largest communities if given. A failed call leaves the default."""
    plain = summarise(membership, node_table, edge_table, limit=limit)
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "kind", "line"))
    shown = facts(membership, node_table, edge_table).withColumn("place", rank).where(F.col("place") <= SHOWN_FACTS)
    listed = shown.groupBy("community").agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", "line")))["line"], "\n").alias("lines"))
    asked = plain.join(listed, "community").select("community", F.concat(F.lit(SUMMARY_PROMPT), "lines").alias("prompt"))
    got = replies(asked, "community", "prompt", model)
    return plain.join(got, "community", "left").select("community", "size", F.coalesce(F.nullif(strip(F.col("reply")), F.lit("")), F.col("summary")).alias("summary"))


def community_table(membership: DataFrame, summaries: DataFrame | None = None, level: int = 0) -> DataFrame:
    """(community_id, nodes, summary, level, size): the sidecar's rows."""
    rows = membership.groupBy("community").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"), F.count("*").alias("size"))
    if summaries is not None:
        rows = rows.join(summaries.select("community", "summary"), "community", "left")
    else:
        rows = rows.withColumn("summary", F.lit(None).cast("string"))
    return rows.select(F.col("community").alias("community_id"), "nodes", F.coalesce("summary", F.lit("")).alias("summary"), F.lit(level).alias("level"), "size")


def has_summaries(communities: DataFrame) -> bool:
    return communities.where(strip(F.coalesce("summary", F.lit(""))) != "").limit(1).count() > 0
