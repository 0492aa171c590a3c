"""What visualisers read: samples of the graph, artifact tables, HTML."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholaspark.lineage import numbered as in_order
from scholaspark.operators.communities import connected_components, numbered
from scholaspark.operators.graph import degrees


def sample(node_table: DataFrame, edge_table: DataFrame, membership: DataFrame, max_nodes: int = 500) -> DataFrame:
    """(node_id, community, degree, place): at most max_nodes nodes, taken in
    turn from each community, larger ones first, by degree; nodes of none
    follow, by degree."""
    sizes = membership.groupBy("community").agg(F.count("*").alias("size"))
    rows = degrees(node_table, edge_table).select("node_id", "degree").join(membership, "node_id", "left").join(sizes, "community", "left")
    turn = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "node_id"))
    placed = rows.withColumn("turn", F.when(F.col("community").isNull(), F.lit(2**31 - 1)).otherwise(turn))
    # A node whose turn is beyond max_nodes can't be chosen.
    near = placed.where((F.col("turn") <= max_nodes) | F.col("community").isNull()).orderBy("turn", F.desc("size"), "community", F.desc("degree"), "node_id").limit(max_nodes)
    order = Window.orderBy("turn", F.desc_nulls_last("size"), "community", F.desc("degree"), "node_id")
    return near.withColumn("place", F.row_number().over(order)).select("node_id", "community", "degree", "place")


def artifacts(node_table: DataFrame, edge_table: DataFrame) -> dict[str, DataFrame]:
    """The seven artifact tables; communities are the connected components.

    The numbers for people go by node_id, by (src, dst) and by size.
    """
    spark = node_table.sparkSession
    none = F.lit("[]")
    label = F.when(F.coalesce("label", F.lit("")) == "", F.col("node_id")).otherwise(F.col("label"))
    entities = in_order(node_table, ["node_id"], "human_readable_id", 1).select(
        F.col("node_id").alias("id"), "human_readable_id", label.alias("title"), F.coalesce(F.nullif("entity_type", F.lit("")), F.lit("UNKNOWN")).alias("type"), F.coalesce("description", F.lit("")).alias("description"), label.alias("name"),
        *(none.alias(c) for c in ("text_unit_ids", "description_embedding", "graph_embedding", "community_ids")),
    )
    degree = degrees(node_table, edge_table).select("node_id", "degree")
    relations = in_order(edge_table, ["src", "dst"], "human_readable_id", 1).join(degree.toDF("src", "source_degree"), "src", "left").join(degree.toDF("dst", "target_degree"), "dst", "left")
    relationships = relations.select(
        F.concat(F.lit("relationship-"), F.col("human_readable_id").cast("string")).alias("id"), "human_readable_id", F.col("src").alias("source"), F.col("dst").alias("target"), F.coalesce("source_degree", F.lit(0)).alias("source_degree"), F.coalesce("target_degree", F.lit(0)).alias("target_degree"),
        "weight", F.col("weight").alias("rank"), F.coalesce("description", F.lit("")).alias("description"), F.to_json("chunk_ids").alias("text_unit_ids"), F.coalesce(F.nullif("relation_type", F.lit("")), F.lit("related_to")).alias("type"),
    )
    parts = numbered(connected_components(node_table, edge_table).withColumnRenamed("component", "c"))
    groups = parts.groupBy((F.col("community") + 1).alias("community")).agg(F.array_sort(F.collect_list("node_id")).alias("nodes"), F.count("*").cast("int").alias("size"))
    number = F.col("community").cast("string")
    shared = [F.col("community").alias("human_readable_id"), "community", F.lit(1).alias("level")]
    rest = [F.lit("Auto-generated from GraphML connected components.").alias("summary"), F.col("size").alias("rank"), F.lit("Derived from community size.").alias("rank_explanation"), none.alias("findings"), *(F.lit("").alias(c) for c in ("full_content", "full_content_json", "period")), "size"]
    communities = groups.select(F.concat(F.lit("community-"), number).alias("id"), *shared, F.concat(F.lit("Community "), number).alias("title"), *rest, F.to_json("nodes").alias("entity_ids"), none.alias("relationship_ids"))
    reports = groups.select(F.concat(F.lit("community-report-"), number).alias("id"), *shared, F.lit(None).cast("int").alias("parent"), F.concat(F.lit("Community "), number, F.lit(" report")).alias("title"), *rest)
    empty = lambda schema: spark.createDataFrame([], schema)
    return {
        "entities": entities, "relationships": relationships, "communities": communities, "community_reports": reports,
        "documents": empty("id string, human_readable_id int, title string, text string, text_unit_ids string, creation_date string"),
        "text_units": empty("id string, human_readable_id int, text string, n_tokens int, document_ids string, entity_ids string, relationship_ids string"),
        "covariates": empty("id string, human_readable_id int, subject_id string, covariate_type string"),
    }


def write_artifacts(node_table: DataFrame, edge_table: DataFrame, folder: str, prefix: bool = False) -> list[str]:
    """Writes the tables as parquet; returns their paths."""
    paths = []
    for name, df in artifacts(node_table, edge_table).items():
        path = f"{folder}/{'create_final_' if prefix else ''}{name}.parquet"
        df.write.mode("overwrite").parquet(path)
        paths.append(path)
    return paths


#: The page's script: draws the graph, lets it settle, and answers to the mouse.
_SCRIPT = """
const g = JSON.parse(document.getElementById('graph').textContent), svg = document.querySelector('svg');
const at = new Map(g.nodes.map(n => [n.node_id, n])), links = g.edges.filter(e => at.has(e.src) && at.has(e.dst));
const lines = [...svg.querySelectorAll('line')], dots = [...svg.querySelectorAll('circle')];
g.nodes.forEach((n, i) => { n.x = +dots[i].getAttribute('cx'); n.y = +dots[i].getAttribute('cy'); n.dot = dots[i]; });
function draw() {
  links.forEach((e, i) => { const a = at.get(e.src), b = at.get(e.dst), l = lines[i]; l.setAttribute('x1', a.x); l.setAttribute('y1', a.y); l.setAttribute('x2', b.x); l.setAttribute('y2', b.y); });
  g.nodes.forEach(n => { n.dot.setAttribute('cx', n.x); n.dot.setAttribute('cy', n.y); });
}
function step(heat) {
  const near = 900000 / Math.max(g.nodes.length, 1);
  g.nodes.forEach(n => { n.fx = (500 - n.x) * 0.01; n.fy = (500 - n.y) * 0.01; });
  for (let i = 0; i < g.nodes.length; i++) for (let j = 0; j < i; j++) {
    const a = g.nodes[i], b = g.nodes[j], dx = a.x - b.x || 0.1, dy = a.y - b.y || 0.1, f = near / (dx * dx + dy * dy + 50) * 0.02;
    a.fx += dx * f; a.fy += dy * f; b.fx -= dx * f; b.fy -= dy * f;
  }
  links.forEach(e => { const a = at.get(e.src), b = at.get(e.dst), dx = (b.x - a.x) * 0.02, dy = (b.y - a.y) * 0.02; a.fx += dx; a.fy += dy; b.fx -= dx; b.fy -= dy; });
  g.nodes.forEach(n => { if (n !== held) { n.x += Math.max(-20, Math.min(20, n.fx)) * heat; n.y += Math.max(-20, Math.min(20, n.fy)) * heat; } });
}
let held = null, heat = 1, view = [0, 0, 1000, 1000];
function run() { if (heat > 0.02) { step(heat); heat *= 0.985; draw(); } requestAnimationFrame(run); }
const place = e => { const p = svg.createSVGPoint(); p.x = e.clientX; p.y = e.clientY; return p.matrixTransform(svg.getScreenCTM().inverse()); };
g.nodes.forEach(n => {
  n.dot.addEventListener('mousedown', e => { held = n; e.preventDefault(); });
  n.dot.addEventListener('mouseenter', () => { links.forEach((e, i) => lines[i].classList.toggle('on', e.src === n.node_id || e.dst === n.node_id)); });
  n.dot.addEventListener('click', () => { const own = links.filter(e => e.src === n.node_id || e.dst === n.node_id); document.getElementById('info').textContent = n.label + '\\n' + own.map(e => at.get(e.src).label + ' --[' + e.relation_type + ']--> ' + at.get(e.dst).label).join('\\n'); });
});
svg.addEventListener('mousemove', e => { if (held) { const p = place(e); held.x = p.x; held.y = p.y; heat = Math.max(heat, 0.3); } });
window.addEventListener('mouseup', () => { held = null; });
svg.addEventListener('wheel', e => { e.preventDefault(); const p = place(e), k = e.deltaY > 0 ? 1.1 : 1 / 1.1; view = [p.x - (p.x - view[0]) * k, p.y - (p.y - view[1]) * k, view[2] * k, view[3] * k]; svg.setAttribute('viewBox', view.join(' ')); }, { passive: false });
document.getElementById('find').addEventListener('input', e => { const t = e.target.value.toLowerCase(); g.nodes.forEach(n => n.dot.classList.toggle('off', t !== '' && !(n.label || '').toLowerCase().includes(t))); });
run();
"""
_STYLE = "body{margin:0;font:14px sans-serif;display:flex}svg{width:75vw;height:100vh}line{stroke:#bbb}line.on{stroke:#333}circle{cursor:pointer}circle.off{opacity:.1}aside{width:23vw;padding:1em}#info{white-space:pre-wrap}"


def write_html(node_table: DataFrame, edge_table: DataFrame, membership: DataFrame, path: str, max_nodes: int = 500) -> str:
    """A page with the sampled graph, that needs nothing else: its nodes settle,
    can be dragged, looked for and clicked for their relations; the wheel zooms.
    At most max_nodes nodes and the edges among them come to the driver."""
    import math

    chosen = sample(node_table, edge_table, membership, max_nodes).join(node_table.select("node_id", "label"), "node_id").orderBy("place").collect()
    ids = {r.node_id: i for i, r in enumerate(chosen)}
    spark = node_table.sparkSession
    kept = spark.createDataFrame([(k,) for k in ids], "node_id string")
    inside = edge_table.join(F.broadcast(kept).withColumnRenamed("node_id", "src"), "src").join(F.broadcast(kept).withColumnRenamed("node_id", "dst"), "dst").select("src", "dst", "relation_type", "weight").collect()
    spot = lambda i: (500 + 440 * math.cos(2 * math.pi * i / max(len(ids), 1)), 500 + 440 * math.sin(2 * math.pi * i / max(len(ids), 1)))
    lines = "".join("<line x1='{:.0f}' y1='{:.0f}' x2='{:.0f}' y2='{:.0f}'/>".format(*spot(ids[e.src]), *spot(ids[e.dst])) for e in inside)
    dots = "".join("<circle cx='{:.0f}' cy='{:.0f}' r='{}' fill='hsl({},60%,50%)'><title>{}</title></circle>".format(*spot(i), 3 + min(r.degree, 20) // 4, (r.community or 0) * 47 % 360, html.escape(r.label or r.node_id)) for i, r in enumerate(chosen))
    data = json.dumps({"nodes": [r.asDict() for r in chosen], "edges": [e.asDict() for e in inside]}, ensure_ascii=False).replace("</", "<\\/")
    page = (
        f"<!doctype html><meta charset='utf-8'><title>Knowledge graph</title><style>{_STYLE}</style><svg viewBox='0 0 1000 1000'>{lines}{dots}</svg>"
        f"<aside><input id='find' placeholder='Find an entity'><p>{len(chosen)} entities, {len(inside)} relations</p><div id='info'></div></aside>"
        f"<script type='application/json' id='graph'>{data}</script><script>{_SCRIPT}</script>"
    )
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(page, encoding="utf-8")
    return path
