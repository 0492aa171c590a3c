"""Sources and sinks: paper records, plain texts, checkpoints, graphs,
communities, questions, records, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAPER = "doc_id string, title string, authors array<string>, abstract string, categories array<string>, year int, full_text string, sections array<struct<heading string, text string>>, source_file string"
_LOOSE = PAPER.replace("sections array<struct<heading string, text string>>", "sections string")
EXTRACTION = "chunk_id string, entities array<struct<name string, entity_type string, description string>>, relations array<struct<source string, target string, relation_type string, description string, chunk_id string>>, status string"
QUESTION = "question string, reference_answer string, relevant_doc_ids array<string>, question_scope string"
COMMUNITY = "community_id int, nodes array<string>, summary string, level int, size int"
NODE = "node_id string, label string, entity_type string, description string"
EDGE = "src string, dst string, relation_type string, description string, weight long, chunk_ids array<string>"


def _inner(schema: str) -> str:
    """A schema as the fields of a struct."""
    return ", ".join(":".join(f.split(" ", 1)) for f in schema.split(", "))


def _stem(column: str = "_metadata.file_name"):
    return F.regexp_replace(F.col(column), r"\.[^.]*$", "")


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Paper records, one JSON file each. Unknown keys are ignored, an absent id
    is the file's name, a file that isn't JSON is left out; sections may be
    objects or only their texts."""
    raw = spark.read.schema(_LOOSE + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(f"{path}/*.json")
    objects = F.from_json("sections", "array<struct<heading:string,text:string>>", {"mode": "PERMISSIVE"})
    texts = F.transform(F.from_json("sections", "array<string>"), lambda x: F.struct(F.lit("").alias("heading"), x.alias("text")))
    # An object read as a string begins with a brace.
    sections = F.when(F.col("sections").rlike(r"^\[\s*\{"), objects).otherwise(texts)
    return raw.where("_bad is null").select(F.coalesce("doc_id", _stem()).alias("doc_id"), "title", "authors", "abstract", "categories", "year", "full_text", sections.alias("sections"), "source_file")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, source_file) of plain text files."""
    raw = spark.read.text(f"{path}/*.txt", wholetext=True)
    return raw.select(_stem().alias("doc_id"), F.col("value").alias("text"), F.col("_metadata.file_name").alias("source_file"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder: its JSON records if it has any, else its texts."""
    from scholaspark.functions.text import lines
    from scholaspark.operators.documents import documents_from_records

    if _matches(spark, f"{path}/*.json"):
        return documents_from_records(read_papers(spark, path))
    if _matches(spark, f"{path}/*.txt"):
        raw = read_texts(spark, path).withColumn("title", F.coalesce(F.try_element_at(lines(F.col("text")), F.lit(1)), F.lit("")))
        none = F.lit(None).cast("string")
        records = raw.select("doc_id", "title", none.alias("abstract"), F.array().cast("array<string>").alias("authors"), F.array().cast("array<string>").alias("categories"), F.lit(None).cast("int").alias("year"), F.col("text").alias("full_text"), F.array().cast("array<struct<heading:string,text:string>>").alias("sections"), "source_file")
        return documents_from_records(records)
    return documents_from_records(spark.createDataFrame([], PAPER))


def _matches(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def preprocess_folder(spark: SparkSession, source: str, target: str) -> None:
    """Plain texts of a folder as paper records, JSON lines of the target."""
    from scholaspark.operators.documents import records_from_text

    records_from_text(read_texts(spark, source)).write.mode("overwrite").json(target)


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Extraction results of a JSON-lines checkpoint. Lines that can't be read
    are left out; an absent status is ok."""
    raw = spark.read.schema(EXTRACTION + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    none = lambda c: F.coalesce(c, F.array().cast(dict(raw.dtypes)[c])).alias(c)
    return raw.where("_bad is null and chunk_id is not null").select("chunk_id", none("entities"), none("relations"), F.coalesce("status", F.lit("ok")).alias("status"))


def append_checkpoint(results: DataFrame, path: str) -> None:
    """Adds results to a checkpoint, one JSON object a line."""
    results.select("chunk_id", "entities", "relations", "status").write.mode("append").json(path)


def not_extracted(chunks: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Chunks without a result in the checkpoint (resume)."""
    return chunks.join(checkpoint.select("chunk_id"), "chunk_id", "left_anti")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as two parquet tables."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


#: The keys of GraphML attributes.
_KEYS = {"node": ("label", "entity_type", "description"), "edge": ("relation_type", "description", "weight", "chunk_ids")}


def _xml(column, name: str, key: str):
    """<data> of a value, or nothing for null."""
    text = F.regexp_replace(F.col(column).cast("string"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.when(F.col(column).isNull(), "").otherwise(F.concat(F.lit(f'<data key="{key}_{name}">'), text, F.lit("</data>")))


def _attribute(column: str):
    text = F.col(column)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph in GraphML, chunk_ids as JSON: one document that other tools
    open if the path ends in .graphml, else a folder of parts that make the
    document when joined in order. The parts are written by the tasks."""
    keys = "".join(f'<key id="{k}_{n}" for="{k}" attr.name="{n}" attr.type="{"long" if n == "weight" else "string"}"/>' for k, names in _KEYS.items() for n in names)
    head = '<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">' + keys + '<graph edgedefault="directed">'
    spark = nodes.sparkSession
    parts = f"{path}.parts" if path.endswith(".graphml") else path
    n = nodes.select(F.concat(F.lit('<node id="'), _attribute("node_id"), F.lit('">'), *(_xml(c, c, "node") for c in _KEYS["node"]), F.lit("</node>")).alias("value"))
    flat = edges.withColumn("chunk_ids", F.to_json("chunk_ids"))
    e = flat.select(F.concat(F.lit('<edge source="'), _attribute("src"), F.lit('" target="'), _attribute("dst"), F.lit('">'), *(_xml(c, c, "edge") for c in _KEYS["edge"]), F.lit("</edge>")).alias("value"))
    one = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    # A union keeps the order of its sides' partitions, and so of the parts.
    one(head).union(n).union(e).union(one("</graph></graphml>")).write.mode("overwrite").option("lineSep", "\n").text(parts)
    if parts != path:
        _joined(spark, parts, path)


def _joined(spark: SparkSession, parts: str, path: str) -> None:
    """Joins the part files of a folder into one file, as a stream between the
    file systems, and takes the folder away."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    folder, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    files = folder.getFileSystem(conf)
    out = target.getFileSystem(conf).create(target, True)
    for name in sorted(f.getPath().getName() for f in files.listStatus(folder)):
        if name.startswith("part-"):
            part = files.open(hadoop.fs.Path(folder, name))
            hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
    out.close()
    files.delete(folder, True)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML document as written above."""
    data = "array<struct<_key:string,_VALUE:string>>"
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    value = lambda key: F.try_element_at(F.transform(F.filter("data", lambda d: d["_key"] == key), lambda d: F.coalesce(d["_VALUE"], F.lit(""))), F.lit(1))
    n = read("node", f"_id string, data {data}").select(F.col("_id").alias("node_id"), *(value(f"node_{c}").alias(c) for c in _KEYS["node"]))
    e = read("edge", f"_source string, _target string, data {data}").select(F.col("_source").alias("src"), F.col("_target").alias("dst"), value("edge_relation_type").alias("relation_type"), value("edge_description").alias("description"), value("edge_weight").cast("long").alias("weight"), F.from_json(value("edge_chunk_ids"), "array<string>").alias("chunk_ids"))
    return n, e


def write_communities(communities: DataFrame, path: str) -> None:
    communities.write.mode("overwrite").json(path)


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    """Communities of a sidecar: JSON lines, or one object with a list of them."""
    raw = spark.read.schema(f"communities array<struct<{_inner(COMMUNITY)}>>, {COMMUNITY}").option("multiLine", not _is_lines(spark, path)).json(path)
    listed = raw.where("communities is not null").select(F.explode("communities").alias("c")).select("c.*")
    rows = listed.unionByName(raw.where("communities is null and community_id is not null").drop("communities"))
    nodes = F.coalesce("nodes", F.array().cast("array<string>"))
    return rows.select("community_id", nodes.alias("nodes"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("size", F.size(nodes)).alias("size"))


def _is_lines(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).limit(1).collect()
    return bool(first) and first[0][0].strip().endswith("}")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions of a JSON array, numbered from 1 in its order; a
    question without text fails, as does a file that is no array of objects."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{_inner(QUESTION)}>>").alias("value"))
    rows = raw.select(F.posexplode("value").alias("pos", "q")).select((F.col("pos") + 1).cast("long").alias("question_id"), "q.*")
    if raw.where("value is null").limit(1).count() or rows.where("trim(coalesce(question, '')) = ''").limit(1).count():
        raise ValueError("an evaluation file is a JSON array of objects with a question each")
    return rows


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines (value) in their order: one file if the path has an ending, else a
    folder of parts."""
    one = "." in path.rsplit("/", 1)[-1]
    parts = f"{path}.parts" if one else path
    lines.write.mode("overwrite").text(parts)
    if one:
        _joined(lines.sparkSession, parts, path)


def write_records(records: DataFrame, path: str, kind: str = "json") -> None:
    """Benchmark records as JSON lines, CSV or parquet."""
    if kind == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in records.dtypes]
        records.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    else:
        getattr(records.write.mode("overwrite"), kind)(path)


def template_questions(spark: SparkSession) -> DataFrame:
    """Questions to begin an evaluation file with."""
    rows = [
        (1, "What is the main contribution of the paper?", "", [], "local"),
        (2, "Which datasets are the results measured on?", "", [], "local"),
        (3, "Which themes do the papers have in common?", "", [], "global"),
    ]
    return spark.createDataFrame(rows, "question_id long, " + QUESTION)

