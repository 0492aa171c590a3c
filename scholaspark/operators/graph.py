"""The knowledge graph as two tables, nodes and edges.

nodes(node_id, label, entity_type, description) and edges(src, dst,
relation_type, description, weight, chunk_ids). A node's key is its cleaned
name in lower case; its attributes come from the first mention as an entity,
or, if it never is one, from its first mention in a relation (type UNKNOWN, no
description). There is one edge per ordered pair, with the first relation's
type and description and the number of relations as weight.

``first`` is by (position of the chunk in ``order``, place in the array). All
aggregates are partial before the shuffle, so a hot node or pair costs one row
per task; only chunk_ids grow with an edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholaspark.functions.text import fold, safe_value
from scholaspark.lineage import cut
from scholaspark.operators.extraction import GOOD


def good_only(extractions: DataFrame) -> DataFrame:
    """Results whose status counts when a graph is built from a checkpoint."""
    return extractions.where(F.coalesce("status", F.lit("ok")).isin(*GOOD))


def _ordered(extractions: DataFrame, order: list[Column]) -> DataFrame:
    return extractions.withColumn("_at", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))))


def entity_mentions(extractions: DataFrame, order: list[Column]) -> DataFrame:
    """(node_id, at, label, entity_type, description), a row per named entity."""
    each = _ordered(extractions, order).select("_at", F.posexplode("entities").alias("pos", "e"))
    label = safe_value(F.col("e.name"))
    return each.select(F.struct("_at", "pos").alias("at"), label.alias("label"), safe_value(F.col("e.entity_type")).alias("entity_type"), safe_value(F.col("e.description")).alias("description")).where("label <> ''").select(
        F.lower("label").alias("node_id"), "*"
    )


def relation_mentions(extractions: DataFrame, order: list[Column]) -> DataFrame:
    """(src, dst, at, source, target, relation_type, description, chunk)."""
    each = _ordered(extractions, order).select("_at", F.posexplode("relations").alias("pos", "r"))
    clean = {n: safe_value(F.col(f"r.{n}")) for n in ("source", "target", "relation_type", "description", "chunk_id")}
    rows = each.select(F.struct("_at", "pos").alias("at"), *(c.alias(n) for n, c in clean.items())).where("source <> '' and target <> ''")
    return rows.select(F.lower("source").alias("src"), F.lower("target").alias("dst"), "*")


def nodes(extractions: DataFrame, order: list[Column]) -> DataFrame:
    entities = entity_mentions(extractions, order).select("node_id", F.struct(F.lit(0).alias("kind"), "at", F.lit(0).alias("end"), "label", "entity_type", "description").alias("first"))
    relations = relation_mentions(extractions, order)
    ends = [
        relations.select(F.col(key).alias("node_id"), F.struct(F.lit(1).alias("kind"), "at", F.lit(i).alias("end"), F.col(name).alias("label"), F.lit("UNKNOWN").alias("entity_type"), F.lit(None).cast("string").alias("description")).alias("first"))
        for i, (key, name) in enumerate((("src", "source"), ("dst", "target")))
    ]
    return entities.unionByName(ends[0]).unionByName(ends[1]).groupBy("node_id").agg(F.min("first").alias("first")).select("node_id", "first.label", "first.entity_type", "first.description")


def edges(extractions: DataFrame, order: list[Column]) -> DataFrame:
    rows = relation_mentions(extractions, order)
    first = F.struct("at", "relation_type", "description")
    chunk = F.when(F.col("chunk_id") != "", F.struct("at", "chunk_id"))
    found = rows.groupBy("src", "dst").agg(F.min(first).alias("first"), F.count("*").alias("weight"), F.array_sort(F.collect_list(chunk)).alias("chunks"))
    return found.select("src", "dst", "first.relation_type", "first.description", "weight", F.col("chunks.chunk_id").alias("chunk_ids"))


def edge_weights(extractions: DataFrame, order: list[Column]) -> DataFrame:
    """edges() without chunk_ids: of fixed size per edge, however hot."""
    rows = relation_mentions(extractions, order)
    found = rows.groupBy("src", "dst").agg(F.min(F.struct("at", "relation_type", "description")).alias("first"), F.count("*").alias("weight"), F.sum((F.col("chunk_id") != "").cast("long")).alias("n_chunks"))
    return found.select("src", "dst", "first.relation_type", "first.description", "weight", "n_chunks")


def edge_chunks(extractions: DataFrame, order: list[Column]) -> DataFrame:
    """(src, dst, chunk_id, n): the chunks that an edge comes from, and how often,
    as rows; for edges whose chunk_ids are too many for one."""
    rows = relation_mentions(extractions, order).where("chunk_id <> ''")
    return rows.groupBy("src", "dst", "chunk_id").agg(F.count("*").alias("n"))


def chunk_entities(extractions: DataFrame, order: list[Column]) -> DataFrame:
    """(chunk_id, node_id): the ends of the edges that a chunk supports."""
    rows = relation_mentions(extractions, order).where("chunk_id <> ''")
    return rows.select("chunk_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()


def degrees(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """(node_id, in_degree, out_degree, degree); a loop counts at both ends."""
    ends = edge_table.select(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edge_table.select(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    sums = ends.groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return node_table.select("node_id").join(sums, "node_id", "left").select("node_id", zero("in_degree"), zero("out_degree")).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def top_entities(node_table: DataFrame, edge_table: DataFrame, n: int = 20) -> DataFrame:
    """The n nodes of highest degree; ties by node_id."""
    return degrees(node_table, edge_table).select("node_id", "degree").orderBy(F.desc("degree"), "node_id").limit(n)


def entity_info(node_table: DataFrame, name: str) -> DataFrame:
    """The node of a name, or no row."""
    return node_table.where(F.col("node_id") == fold(F.lit(name)))


def expand(seeds: DataFrame, edge_table: DataFrame, hops: int = 1) -> DataFrame:
    """(seed columns, node_id): the nodes within ``hops`` edges of the seeds,
    along the edges' direction, as an ego graph has them. ``seeds`` has node_id
    and any key columns, each key being expanded on its own."""
    reached = seeds.distinct()
    frontier = reached
    steps = edge_table.select(F.col("src").alias("node_id"), F.col("dst").alias("_next")).distinct()
    for hop in range(hops):
        if hop:
            # Else each hop would compute all hops before it again, twice.
            reached, frontier = cut(reached), cut(frontier)
        new = frontier.join(steps, "node_id").drop("node_id").withColumnRenamed("_next", "node_id").select(*reached.columns).distinct()
        frontier = new.join(reached, reached.columns, "left_anti")
        reached = reached.unionByName(new).distinct()
    return reached


def neighbours(edge_table: DataFrame, node_table: DataFrame, name: str, hops: int = 1) -> DataFrame:
    """(node_id) of the ego graph of a name; no row for an unknown name."""
    return expand(entity_info(node_table, name).select("node_id"), edge_table, hops)


def context_lines(members: DataFrame, node_table: DataFrame, edge_table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line): the edges among each key's nodes, as readable lines."""
    label = node_table.select("node_id", "label")
    a = members.select(*keys, F.col("node_id").alias("src"))
    b = members.select(*keys, F.col("node_id").alias("dst"))
    inside = a.join(edge_table.select("src", "dst", "relation_type"), "src").join(b, [*keys, "dst"])
    named = inside.join(label.toDF("src", "src_label"), "src").join(label.toDF("dst", "dst_label"), "dst")
    line = F.concat("src_label", F.lit(" --["), F.coalesce("relation_type", F.lit("related_to")), F.lit("]--> "), "dst_label")
    return named.select(*keys, "src", "dst", line.alias("line"))
