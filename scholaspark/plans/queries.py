"""The core's queries over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholaspark.functions import text as T
from scholaspark.lineage import cut
from scholaspark.operators import benchmark as B
from scholaspark.operators import chunking as C
from scholaspark.operators import communities as CO
from scholaspark.operators import documents as D
from scholaspark.operators import extraction as X
from scholaspark.operators import graph as G
from scholaspark.operators import metrics as M
from scholaspark.operators import retrieval as R
from scholaspark.operators import vectors as V
from scholaspark.operators import visual as VI
from scholaspark.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _order() -> list:
    """The order in which extraction results count: by arrival."""
    return [F.col("ingested_at"), F.col("chunk_id"), F.col("extracted_at"), F.col("status"), F.xxhash64("entities", "relations")]


def _extractions(spark: SparkSession, d: str) -> DataFrame:
    """Extraction results; a repeated load of the same result counts once."""
    return D.first_loads(table(spark, d, "extractions"), ["chunk_id", "extracted_at", "status"], [F.col("ingested_at")])


def _records(spark: SparkSession, d: str) -> DataFrame:
    return D.first_loads(table(spark, d, "eval_records"), ["record_id"], [F.col("loaded_at")])


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return D.first_loads(table(spark, d, "chunks"), ["chunk_id"], [F.col("ingested_at")])


def _papers(spark: SparkSession, d: str) -> DataFrame:
    """The first load of each paper."""
    return D.first_loads(table(spark, d, "papers"), ["doc_id"], [F.col("ingested_at"), F.col("year").desc_nulls_last(), F.col("source_file")])


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _extractions(spark, d)
    return cut(G.nodes(rows, _order())), cut(G.edges(rows, _order()))


_STRIP = r"'^[\s\pZ\x1c-\x1f\x85]+|[\s\pZ\x1c-\x1f\x85]+$'"
_EXTRACTIONS = "extractions_once AS (SELECT * FROM extractions QUALIFY row_number() OVER (PARTITION BY chunk_id, extracted_at, status ORDER BY ingested_at) = 1)"
_RECORDS = "records AS (SELECT * FROM eval_records QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY loaded_at) = 1)"


def _safe(c: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({c}, ''), {_STRIP}, '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')"


_ENTITIES = f"entity AS (SELECT {_safe('e.name')} AS label, {_safe('e.entity_type')} AS entity_type FROM (SELECT unnest(entities) AS e FROM extractions_once))"
_RELATIONS = f"relation AS (SELECT {_safe('r.source')} AS source, {_safe('r.target')} AS target, {_safe('r.relation_type')} AS relation_type, {_safe('r.chunk_id')} AS chunk FROM (SELECT unnest(relations) AS r FROM extractions_once))"
_EDGES = "edge AS (SELECT lower(source) AS src, lower(target) AS dst, count(*) AS weight, sum(CASE WHEN chunk <> '' THEN 1 ELSE 0 END) AS n_chunks FROM relation WHERE source <> '' AND target <> '' GROUP BY ALL)"
_NODES = "node AS (SELECT DISTINCT lower(label) AS node_id FROM entity WHERE label <> '' UNION SELECT src FROM edge UNION SELECT dst FROM edge)"
_GRAPH = f"WITH {_EXTRACTIONS}, {_ENTITIES}, {_RELATIONS}, {_EDGES}, {_NODES}"

# --- documents ---------------------------------------------------------------


@query("SELECT doc_id, coalesce(title, '') AS title, year, length(coalesce(full_text, '')) AS n_chars, coalesce(len(authors), 0) AS n_authors, coalesce(len(sections), 0) AS n_sections FROM papers QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at, year DESC NULLS LAST, source_file) = 1")
def papers_read(spark, d):
    docs = D.documents_from_records(_papers(spark, d))
    return docs.select("doc_id", "title", "year", F.length("text").cast("long").alias("n_chars"), F.size("authors").cast("long").alias("n_authors"), F.coalesce(F.size("sections"), F.lit(0)).cast("long").alias("n_sections"))


_PAPERS = "first_papers AS (SELECT * FROM papers QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at, year DESC NULLS LAST, source_file) = 1)"


@query(f"WITH {_PAPERS} SELECT doc_id, title, CAST(instr(lower(title), 'claim') - 1 AS INTEGER) AS position FROM first_papers WHERE contains(lower(title), 'claim') ORDER BY position, doc_id LIMIT 10")
def title_search(spark, d):
    return D.search_by_title(_papers(spark, d), "Claim").select("doc_id", "title", "position")


@query(f"WITH {_PAPERS} SELECT doc_id, year FROM first_papers WHERE year = 2044 AND len(list_filter(categories, lambda x: contains(lower(x), 'cs.'))) > 0 AND len(list_filter(authors, lambda x: contains(lower(x), 'ma'))) > 0")
def metadata_search(spark, d):
    return D.search_by_metadata(_papers(spark, d), 2044, "CS.", "ma").select("doc_id", "year")


def _bare(c: str) -> str:
    return f"regexp_replace({c}, {_STRIP}, '', 'g')"


_CHUNKS = "first_chunks AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at) = 1)"
_LINES = f"raw AS (SELECT doc_id, coalesce(full_text, '') AS t, string_split(coalesce(full_text, ''), chr(10)) AS r FROM first_papers), lined AS (SELECT *, list_filter(list_transform(r, lambda x: {_bare('x')}), lambda x: x <> '') AS l FROM raw)"
_NAMED = f"list_filter(list_transform(list_filter(l[2:6], lambda x: contains(x, ',') AND NOT regexp_matches(x, '\\d{{4}}')), lambda x: list_filter(list_transform(regexp_split_to_array(x, '{T.NAMES}'), lambda n: {_bare('n')}), lambda n: length(n) BETWEEN 3 AND 49)), lambda n: len(n) BETWEEN 1 AND 20)"


@query(rf"""
WITH {_PAPERS}, {_LINES},
opened AS (SELECT doc_id, list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)^abstract')), TRUE) AS f, l FROM lined),
body AS (SELECT doc_id, list_filter(list_concat([regexp_replace(l[f], '(?i)^abstract[:\s]*', '')], l[f + 1 :]), lambda x: x <> '') AS w FROM opened WHERE f > 0),
ended AS (SELECT doc_id, w, list_position(list_transform(w[2:], lambda x: regexp_matches(x, '{T.AFTER_ABSTRACT}')), TRUE) AS e FROM body),
abstracts AS (SELECT doc_id, left(array_to_string(w[1:e], ' '), {T.ABSTRACT}) AS abstract FROM ended WHERE e > 0)
SELECT lined.doc_id, array_to_string(list_filter(l[1:5], lambda x: length(x) >= 5 AND NOT regexp_matches(x, '{T.NO_TITLE}'))[1:2], ' ') AS title, coalesce(array_to_string(({_NAMED})[1], '; '), '') AS authors, coalesce(abstract, '') AS abstract,
       CASE WHEN regexp_matches(lined.doc_id, '^\d{{4}}\.') THEN CAST(left(lined.doc_id, 2) AS INTEGER) + CASE WHEN left(lined.doc_id, 2) < '50' THEN 2000 ELSE 1900 END ELSE CAST(nullif(regexp_extract(left(t, 500), '20[12]\d'), '') AS INTEGER) END AS year
FROM lined LEFT JOIN abstracts USING (doc_id)
""")
def records_from_text(spark, d):
    """The guessed parts of the papers' texts, but for their sections."""
    raw = _papers(spark, d).select("doc_id", F.col("full_text").alias("text"), "source_file")
    return D.records_from_text(raw).select("doc_id", "title", F.array_join("authors", "; ").alias("authors"), "abstract", "year")


@query(rf"""
WITH {_PAPERS}, {_LINES},
rows AS (SELECT doc_id, i, r[i] AS raw, {_bare('r[i]')} AS x, len(r) AS n FROM (SELECT doc_id, r, unnest(range(1, len(r) + 1)) AS i FROM lined)),
full_rows AS (SELECT *, lead(x) OVER w AS nx, lead(i) OVER w AS ni FROM rows WHERE x <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
heads AS (
  SELECT doc_id, n, i AS starts, i AS line, x AS said FROM full_rows WHERE regexp_matches(x, '{T.NUMBERED}{T.TITLED}$')
  UNION ALL SELECT doc_id, n, i, ni, nx FROM full_rows WHERE NOT regexp_matches(x, '{T.NUMBERED}{T.TITLED}$') AND regexp_matches(x, '{T.NUMBER}$') AND regexp_matches(coalesce(nx, ''), '^{T.TITLED}$')
),
placed AS (SELECT *, coalesce(lead(starts) OVER (PARTITION BY doc_id ORDER BY starts), n + 1) AS until FROM heads WHERE starts > 1 AND line < n)
SELECT p.doc_id, CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY starts) - 1 AS INTEGER) AS place, regexp_replace(said, '{T.NUMBERED}', '') AS heading, md5(left({_bare("coalesce(array_to_string(r[line + 1 : until - 1], chr(10)), '')")}, {T.SECTION})) AS digest
FROM placed p JOIN lined USING (doc_id)
""")
def sections_from_text(spark, d):
    """The sections found in the papers' texts."""
    raw = _papers(spark, d).select("doc_id", F.col("full_text").alias("text"), "source_file")
    return D.records_from_text(raw).select("doc_id", F.posexplode("sections").alias("place", "s")).select("doc_id", "place", "s.heading", F.md5("s.text").alias("digest"))


@query(rf"WITH {_CHUNKS}, c AS (SELECT chunk_id, nfc_normalize(regexp_replace(text, '[^\PC\n\t]', '', 'g')) AS t FROM first_chunks) SELECT chunk_id, md5({_bare("regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g')")}) AS digest FROM c")
def prepared_texts(spark, d):
    """The cleaning that comes before chunking."""
    return _chunks(spark, d).select("chunk_id", F.md5(T.prepared(F.col("text"))).alias("digest"))


@query(r"WITH " + _PAPERS + r", t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(full_text, ''), chr(12), chr(10), 'g'), '-\n([\pL\pN\pM_])', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM first_papers) SELECT doc_id, md5(regexp_replace(t, " + _STRIP + r", '', 'g')) AS digest FROM t")
def reading_text(spark, d):
    return _papers(spark, d).select("doc_id", F.md5(T.reading_text(F.coalesce("full_text", F.lit("")))).alias("digest"))


@query("SELECT chunk_id, split_part(chunk_id, '__', 1) AS doc_first, regexp_replace(chunk_id, '^(.*)__chunk_.*$', '\\1') AS doc_last FROM (SELECT DISTINCT chunk_id FROM chunks)")
def chunk_documents(spark, d):
    ids = table(spark, d, "chunks").select("chunk_id").distinct()
    return ids.select("chunk_id", T.doc_of_chunk(F.col("chunk_id")).alias("doc_first"), T.doc_of_chunk_last(F.col("chunk_id")).alias("doc_last"))


@query("SELECT DISTINCT p.doc_id FROM papers p WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.doc_id = p.doc_id AND c.index >= 2)")
def papers_not_chunked(spark, d):
    """The manifest here names the papers with a third chunk."""
    manifest = D.manifest_of(table(spark, d, "chunks").where("index >= 2"))
    return D.not_indexed(table(spark, d, "papers").select("doc_id").distinct(), manifest)


@query("SELECT doc_id, count(*) AS n_chunks, min(index) AS first_index, max(index) AS last_index, sum(length(coalesce(text, ''))) AS n_chars FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at) = 1) GROUP BY doc_id")
def chunks_per_document(spark, d):
    rows = _chunks(spark, d)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min("index").alias("first_index"), F.max("index").alias("last_index"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"))


# --- chunking and vectors ------------------------------------------------------


@query()
def token_chunks(spark, d):
    return C.prepare_and_chunk(D.documents_from_records(_papers(spark, d)), size=256, overlap=32).drop("metadata")


@query()
def chunk_token_counts(spark, d):
    return C.token_counts(_chunks(spark, d), "chunk_id", "text")


@query()
def chunk_embeddings(spark, d):
    return R.embedded(_chunks(spark, d), "chunk_id", "text", "chunk_id")


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS score FROM v q, v WHERE q.vec_id % 20 = 0)
SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5
""")
def nearest_vectors(spark, d):
    vectors = table(spark, d, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.search(vectors, asked, 5, id_column="vec_id").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT CAST(count(DISTINCT vec_id) AS BIGINT) AS n_queries, TRUE AS enough FROM embeddings WHERE vec_id % 20 = 0")
def vector_index_recall(spark, d):
    """Whether the index finds at least 0.9 of what the exact search finds."""
    vectors = table(spark, d, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = V.VectorIndex.build(vectors, "vec_id").search(asked, 5).select("query_id", "id", F.lit(1).alias("hit"))
    exact = V.search(vectors, asked, 5, id_column="vec_id").select("query_id", "id").join(near, ["query_id", "id"], "left")
    return exact.agg(F.countDistinct("query_id").alias("n_queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))


@query("SELECT label, count(*) AS n, count(DISTINCT vec_id) AS n_ids FROM embeddings GROUP BY label")
def vector_counts(spark, d):
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("n_ids"))


@query()
def title_clusters(spark, d):
    titles = R.embedded(_papers(spark, d), "doc_id", "title", "id")
    return V.cluster(titles, 10).withColumnRenamed("id", "doc_id")


# --- extraction ------------------------------------------------------------------


def _cases(column: str, pairs: dict, other: str) -> str:
    quote = lambda x: x.replace("'", "''")
    return f"CASE {' '.join(f'WHEN {column} = {chr(39)}{quote(a)}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in pairs.items())} ELSE {other} END"


@query(f"WITH {_EXTRACTIONS}, x AS (SELECT e.entity_type AS raw FROM (SELECT unnest(entities) AS e FROM extractions_once)) SELECT CASE WHEN raw IN ({', '.join(repr(k) for k in [*X.ENTITY_TYPES, 'UNKNOWN'])}) THEN raw ELSE {_cases('trim(lower(coalesce(raw, ' + repr('') + ')))', X._TYPE_OF, repr('UNKNOWN'))} END AS entity_type, count(*) AS n FROM x GROUP BY ALL")
def canonical_entity_types(spark, d):
    each = X.normalised(_extractions(spark, d)).select(F.explode("entities").alias("e"))
    return each.groupBy(F.col("e.entity_type").alias("entity_type")).agg(F.count("*").alias("n"))


@query(f"WITH {_EXTRACTIONS}, x AS (SELECT trim(lower(coalesce(r.relation_type, ''))) AS raw FROM (SELECT unnest(relations) AS r FROM extractions_once)) SELECT {_cases('raw', X._RELATION_OF, 'replace(raw, ' + repr(' ') + ', ' + repr('_') + ')')} AS relation_type, count(*) AS n FROM x GROUP BY ALL")
def canonical_relation_types(spark, d):
    each = X.normalised(_extractions(spark, d)).select(F.explode("relations").alias("r"))
    return each.groupBy(F.col("r.relation_type").alias("relation_type")).agg(F.count("*").alias("n"))


@query(f"WITH {_EXTRACTIONS} SELECT coalesce(status, 'ok') AS status, count(*) AS n, sum(CASE WHEN coalesce(status, 'ok') IN ('ok', 'fallback_success') THEN 1 ELSE 0 END) AS n_good, sum(coalesce(len(entities), 0)) AS n_entities FROM extractions_once GROUP BY ALL")
def extraction_statuses(spark, d):
    good = F.coalesce("status", F.lit("ok")).isin(*X.GOOD)
    rows = _extractions(spark, d).groupBy(F.coalesce("status", F.lit("ok")).alias("status"))
    return rows.agg(F.count("*").alias("n"), F.sum(good.cast("long")).alias("n_good"), F.sum(F.coalesce(F.size("entities"), F.lit(0)).cast("long")).alias("n_entities"))


@query("SELECT DISTINCT c.chunk_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM extractions e WHERE e.chunk_id = c.chunk_id)")
def chunks_not_extracted(spark, d):
    from scholaspark.sources.files import not_extracted

    return not_extracted(table(spark, d, "chunks").select("chunk_id").distinct(), table(spark, d, "extractions"))


_SPACE = r"[\s\x0b\pZ\x1c-\x1f\x85]"
_LETTERS = r"[\pL\pM\p{Nd}\p{Pc}\x{200c}\x{200d}]"
_SHARE = r"CAST(length(regexp_replace({0}, '[^\pL]', '', 'g')) AS DOUBLE) / greatest(length({0}), 1)"


def _greedy(pattern: str) -> str:
    """A pattern without what only the JVM knows."""
    return pattern.replace("++", "+").replace("*+", "*").replace("'", "''")


@query(rf"""
WITH {_CHUNKS},
a AS (SELECT chunk_id, regexp_replace(regexp_replace(coalesce(text, ''), '{_greedy(X._FORMULAS)}', ' ', 'g'), '{_greedy(X._command(3))}', ' ', 'g') AS t FROM first_chunks),
b AS (SELECT chunk_id, array_to_string(list_transform(regexp_extract_all(t, '{_LETTERS}+\[[^\]]{{1,20}}\]|{_LETTERS}+|[\s\S]'), lambda x: CASE WHEN NOT regexp_matches(x, '^{_LETTERS}+\[') THEN x WHEN length(regexp_replace(split_part(x, '[', 1), '[^\pL]', '', 'g')) >= 2 THEN split_part(x, '[', 1) ELSE '' END), '') AS t FROM a),
c AS (SELECT chunk_id, list_filter(regexp_extract_all(t, '[^\s\x0b]+|[\s\x0b]+'), lambda w: NOT (regexp_matches(w, '[{X.MATH_SIGNS}]') AND {_SHARE.format('w')} < {X.FORMULA_LETTERS})) AS w FROM b),
w AS (SELECT chunk_id, list_filter(regexp_split_to_array(array_to_string(w, ''), '{_SPACE}+'), lambda x: x <> '') AS w FROM c),
n AS (SELECT chunk_id, len(list_filter(w, lambda x: {_SHARE.format('x')} >= {X.WORD_SHARE})) AS n_words, CAST(len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Lu}}'))) AS DOUBLE) / greatest(len(w), 1) AS capitals, len(w) AS n FROM w)
SELECT chunk_id, CAST(n_words AS INTEGER) AS n_words, round(capitals, 6) AS capitals, CASE WHEN n_words < {X.LEAST_WORDS} THEN 'skipped_math' WHEN n + {X._OVERHEAD} > {int(2048 * X._SAFE) - X._RESERVE} AND n >= {X.LEAST_CUT} THEN 'split' ELSE 'call' END AS plan FROM n
""")
def extraction_plan(spark, d):
    return X.planned(_chunks(spark, d)).select("chunk_id", "n_words", F.round("capitals", 6).alias("capitals"), "plan")


@query()
def extracted_entities(spark, d):
    return X.extract(_chunks(spark, d))


# --- the graph -------------------------------------------------------------------


@query(f"{_GRAPH} SELECT * FROM edge")
def graph_edges(spark, d):
    return G.edge_weights(_extractions(spark, d), _order()).select("src", "dst", "weight", "n_chunks")


@query(f"{_GRAPH} SELECT n.node_id, n.node_id IN (SELECT lower(label) FROM entity WHERE label <> '') AS is_entity FROM node n")
def graph_nodes(spark, d):
    # A node known from relations only has no description.
    return G.nodes(_extractions(spark, d), _order()).select("node_id", F.col("description").isNotNull().alias("is_entity"))


_AT = "ingested_at NULLS FIRST, chunk_id NULLS FIRST, extracted_at NULLS FIRST, status NULLS FIRST, pos"
_FULL = f"""{_EXTRACTIONS},
entity_row AS (SELECT ingested_at, chunk_id, extracted_at, status, pos, {_safe('entities[pos].name')} AS label, {_safe('entities[pos].entity_type')} AS entity_type, {_safe('entities[pos].description')} AS description FROM (SELECT *, unnest(range(1, len(entities) + 1)) AS pos FROM extractions_once)),
relation_row AS (SELECT ingested_at, chunk_id, extracted_at, status, pos, {_safe('relations[pos].source')} AS source, {_safe('relations[pos].target')} AS target, {_safe('relations[pos].relation_type')} AS relation_type, {_safe('relations[pos].description')} AS description, {_safe('relations[pos].chunk_id')} AS chunk FROM (SELECT *, unnest(range(1, len(relations) + 1)) AS pos FROM extractions_once)),
mention AS (
  SELECT 0 AS kind, 0 AS side, label, entity_type, description, ingested_at, chunk_id, extracted_at, status, pos FROM entity_row WHERE label <> ''
  UNION ALL SELECT 1, 0, source, 'UNKNOWN', NULL, ingested_at, chunk_id, extracted_at, status, pos FROM relation_row WHERE source <> '' AND target <> ''
  UNION ALL SELECT 1, 1, target, 'UNKNOWN', NULL, ingested_at, chunk_id, extracted_at, status, pos FROM relation_row WHERE source <> '' AND target <> ''
),
nodes AS (SELECT lower(label) AS node_id, label, entity_type, description FROM mention QUALIFY row_number() OVER (PARTITION BY lower(label) ORDER BY kind, {_AT}, side) = 1),
edges AS (SELECT lower(source) AS src, lower(target) AS dst, arg_min(relation_type, n) AS relation_type, arg_min(description, n) AS description, count(*) AS weight, list(chunk ORDER BY n) FILTER (WHERE chunk <> '') AS chunk_ids FROM (SELECT *, row_number() OVER (ORDER BY {_AT}) AS n FROM relation_row WHERE source <> '' AND target <> '') GROUP BY ALL)"""


@query(f"WITH {_FULL} SELECT * FROM nodes")
def graph_node_attributes(spark, d):
    return G.nodes(_extractions(spark, d), _order())


@query(f"WITH {_FULL} SELECT src, dst, relation_type, description, weight, coalesce(array_to_string(chunk_ids, ' '), '') AS chunk_ids FROM edges")
def graph_edge_attributes(spark, d):
    return G.edges(_extractions(spark, d), _order()).withColumn("chunk_ids", F.array_join("chunk_ids", " "))


@query(f"{_GRAPH} SELECT lower(source) AS src, lower(target) AS dst, chunk AS chunk_id, count(*) AS n FROM relation WHERE source <> '' AND target <> '' AND chunk <> '' GROUP BY ALL")
def graph_edge_chunks(spark, d):
    return G.edge_chunks(_extractions(spark, d), _order())


@query(f"{_GRAPH.replace('FROM extractions QUALIFY', 'FROM extractions WHERE coalesce(status, ' + repr('ok') + ') IN (' + repr('ok') + ', ' + repr('fallback_success') + ') QUALIFY')} SELECT * FROM edge")
def topology_edges(spark, d):
    return G.edge_weights(G.good_only(_extractions(spark, d)), _order()).select("src", "dst", "weight", "n_chunks")


_DEGREES = "degree AS (SELECT n.node_id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, coalesce(i, 0) + coalesce(o, 0) AS degree FROM node n LEFT JOIN (SELECT dst, count(*) AS i FROM edge GROUP BY dst) x ON x.dst = n.node_id LEFT JOIN (SELECT src, count(*) AS o FROM edge GROUP BY src) y ON y.src = n.node_id)"


@query(f"{_GRAPH}, {_DEGREES} SELECT * FROM degree")
def graph_degrees(spark, d):
    return G.degrees(*_graph(spark, d))


@query(f"{_GRAPH}, {_DEGREES} SELECT node_id, degree FROM degree ORDER BY degree DESC, node_id LIMIT 20")
def graph_top_entities(spark, d):
    return G.top_entities(*_graph(spark, d))


@query(f"{_GRAPH}, {_DEGREES}, seed AS (SELECT node_id FROM degree ORDER BY degree DESC, node_id LIMIT 20), one AS (SELECT DISTINCT s.node_id AS seed, dst AS node_id FROM seed s JOIN edge ON src = s.node_id UNION SELECT node_id, node_id FROM seed) SELECT * FROM one UNION SELECT o.seed, dst FROM one o JOIN edge ON src = o.node_id")
def graph_neighbourhoods(spark, d):
    nodes, edges = _graph(spark, d)
    seeds = G.top_entities(nodes, edges).select(F.col("node_id").alias("seed"), "node_id")
    return G.expand(seeds, edges, 2)


@query(f"{_GRAPH} SELECT DISTINCT chunk AS chunk_id, lower(unnest([source, target])) AS node_id FROM relation WHERE source <> '' AND target <> '' AND chunk <> ''")
def graph_chunk_entities(spark, d):
    return G.chunk_entities(_extractions(spark, d), _order())


_PARTS = f"""WITH RECURSIVE {_FULL},
link AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
reach AS (SELECT node_id, node_id AS other FROM nodes UNION SELECT reach.node_id, link.b FROM reach JOIN link ON link.a = reach.other),
component AS (SELECT node_id, min(other) AS component FROM reach GROUP BY node_id),
part AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS community, count(*) AS size FROM component GROUP BY component),
member AS (SELECT node_id, CAST(community AS INTEGER) AS community, size FROM component JOIN part USING (component)),
degree AS (SELECT node_id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, coalesce(i, 0) + coalesce(o, 0) AS degree FROM nodes LEFT JOIN (SELECT dst AS node_id, count(*) AS i FROM edges GROUP BY dst) USING (node_id) LEFT JOIN (SELECT src AS node_id, count(*) AS o FROM edges GROUP BY src) USING (node_id))"""


def _parts(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph, and its connected parts as communities."""
    nodes, edges = _graph(spark, d)
    return nodes, edges, cut(CO.numbered(CO.connected_components(nodes, edges).withColumnRenamed("component", "c")))


@query(f"{_PARTS} SELECT * FROM component")
def graph_components(spark, d):
    return CO.connected_components(*_graph(spark, d))


@query(f"{_PARTS} SELECT node_id, community FROM member")
def component_numbers(spark, d):
    """The connected parts as communities: larger ones first."""
    return _parts(spark, d)[2].select("node_id", "community")


@query(f"""{_PARTS}, pair AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges),
inside AS (SELECT x.community AS ca, y.community AS cb FROM pair JOIN member x ON x.node_id = a JOIN member y ON y.node_id = b),
ends AS (SELECT community, count(*) AS k FROM (SELECT ca AS community FROM inside UNION ALL SELECT cb FROM inside) GROUP BY community),
within AS (SELECT ca AS community, count(*) AS l FROM inside WHERE ca = cb GROUP BY ca)
SELECT round(sum(coalesce(l, 0) / m - (k / (2.0 * m)) * (k / (2.0 * m))), 9) AS modularity FROM ends LEFT JOIN within USING (community) CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS m FROM pair)""")
def component_quality(spark, d):
    """The modularity of the connected parts."""
    _, edges, members = _parts(spark, d)
    return CO.modularity(members, edges).select(F.round("modularity", 9).alias("modularity"))


@query(f"""{_PARTS}, named AS (SELECT * FROM member JOIN nodes USING (node_id))
SELECT community, 'entity' AS kind, 'Entity: ' || label || ' (type: ' || coalesce(entity_type, '') || ')' AS line FROM named
UNION ALL SELECT x.community, 'relation', 'Relation: ' || x.label || ' --[' || coalesce(relation_type, 'related_to') || ']--> ' || y.label FROM edges JOIN named x ON x.node_id = src JOIN named y ON y.node_id = dst""")
def component_facts(spark, d):
    """What summaries of the connected parts are written from."""
    nodes, edges, members = _parts(spark, d)
    return CO.facts(members, nodes, edges).drop("degree")


@query(f"""{_PARTS}, top AS (SELECT community, size, label, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node_id) AS rank FROM member JOIN degree USING (node_id) JOIN nodes USING (node_id))
SELECT community, size, 'A community of ' || size || ' entities around ' || string_agg(label, ', ' ORDER BY rank) || '.' AS summary FROM top WHERE rank <= 5 GROUP BY community, size""")
def component_summaries(spark, d):
    """The default summaries of the connected parts."""
    nodes, edges, members = _parts(spark, d)
    return CO.summarise(members, nodes, edges)


@query(f"""{_PARTS}, turned AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node_id) AS turn FROM member JOIN degree USING (node_id))
SELECT node_id, community, degree, CAST(row_number() OVER (ORDER BY turn, size DESC, community, degree DESC, node_id) AS INTEGER) AS place FROM turned QUALIFY place <= 200""")
def component_sample(spark, d):
    """A sample of the graph for drawing, in turn from its connected parts."""
    nodes, edges, members = _parts(spark, d)
    return VI.sample(nodes, edges, members, 200)


@query(f"{_PARTS} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM nodes) AS n_members, TRUE AS numbered_from_0, TRUE AS larger_first, TRUE AS within_components, TRUE AS better_than_components")
def community_checks(spark, d):
    """What must hold of any communities: all nodes have one, the numbers are 0
    and up in order of size, none joins two connected parts, and the modularity
    is at least that of the connected parts."""
    nodes, edges, parts = _parts(spark, d)
    members = cut(CO.detect(nodes, edges))
    sizes = members.groupBy("community").agg(F.count("*").alias("n"))
    one = sizes.agg(F.sum("n").alias("n_members"), (F.max("community") + 1 == F.count("*")).alias("numbered_from_0"), F.array_sort(F.collect_list(F.struct("community", "n")))["n"].alias("ns"))
    spread = members.join(parts.withColumnRenamed("community", "part"), "node_id").groupBy("community").agg(F.countDistinct("part").alias("p")).agg((F.max("p") == 1).alias("within_components"))
    better = CO.modularity(members, edges).withColumnRenamed("modularity", "m").crossJoin(CO.modularity(parts, edges)).select((F.col("m") >= F.col("modularity")).alias("better_than_components"))
    ordered = F.col("ns") == F.sort_array("ns", False)
    return one.crossJoin(spread).crossJoin(better).crossJoin(nodes.agg(F.count("*").alias("n_nodes"))).select("n_nodes", "n_members", "numbered_from_0", ordered.alias("larger_first"), "within_components", "better_than_components")


@query()
def graph_communities(spark, d):
    return CO.detect(*_graph(spark, d))


@query()
def community_quality(spark, d):
    nodes, edges = _graph(spark, d)
    return CO.modularity(cut(CO.detect(nodes, edges)), edges)


@query(f"""WITH {_FULL} SELECT node_id AS id, row_number() OVER (ORDER BY node_id) AS human_readable_id, CASE WHEN coalesce(label, '') = '' THEN node_id ELSE label END AS title, coalesce(nullif(entity_type, ''), 'UNKNOWN') AS type, coalesce(description, '') AS description FROM nodes""")
def artifact_entities(spark, d):
    return VI.artifacts(*_graph(spark, d))["entities"].select("id", "human_readable_id", "title", "type", "description")


@query(f"""{_PARTS}, n AS (SELECT *, row_number() OVER (ORDER BY src, dst) AS no FROM edges)
SELECT 'relationship-' || no AS id, no AS human_readable_id, src AS source, dst AS target, x.degree AS source_degree, y.degree AS target_degree, weight, weight AS rank, coalesce(description, '') AS description, '[' || coalesce(array_to_string(list_transform(chunk_ids, lambda c: '"' || c || '"'), ','), '') || ']' AS text_unit_ids, coalesce(nullif(relation_type, ''), 'related_to') AS type
FROM n JOIN degree x ON x.node_id = src JOIN degree y ON y.node_id = dst""")
def artifact_relationships(spark, d):
    return VI.artifacts(*_graph(spark, d))["relationships"]


@query(f"""{_PARTS}, p AS (SELECT CAST(community + 1 AS INTEGER) AS community, CAST(any_value(size) AS INTEGER) AS size, md5(string_agg(node_id, chr(10) ORDER BY node_id)) AS members FROM member GROUP BY community)
SELECT 'community-' || community AS id, community AS human_readable_id, 1 AS level, 'Community ' || community AS title, size AS rank, size, members FROM p""")
def artifact_communities(spark, d):
    """The communities' table, its list of members as a digest."""
    rows = VI.artifacts(*_graph(spark, d))["communities"]
    members = F.md5(F.array_join(F.from_json("entity_ids", "array<string>"), "\n"))
    return rows.select("id", "human_readable_id", "level", "title", "rank", "size", members.alias("members"))


# --- retrieval ---------------------------------------------------------------------


def _questions(spark, d) -> DataFrame:
    return B.questions_of(table(spark, d, "eval_questions")).withColumnRenamed("question_id", "query_id")


def _letters(text):
    """An embedding that SQL can say too: how often each letter stands in a text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.array(*((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("float") for c in "abcdefghijklmnopqrstuvwxyz"))


def _letters_sql(c: str) -> str:
    return f"list_transform({list('abcdefghijklmnopqrstuvwxyz')}, lambda c: CAST(length(lower(coalesce({c}, ''))) - length(replace(lower(coalesce({c}, '')), c, '')) AS DOUBLE))"


_QUESTIONS = "question AS (SELECT question_id AS query_id, trim(question) AS question FROM eval_questions WHERE trim(coalesce(question, '')) <> '' QUALIFY row_number() OVER (PARTITION BY lower(trim(question)) ORDER BY question_id) = 1)"


def _nearest(what: str, key: str, text: str, k: int) -> str:
    """The k nearest of a table's texts to each question."""
    return f"""asked_{what} AS (SELECT query_id, {_letters_sql('question')} AS v FROM question), known_{what} AS (SELECT {key}, {_letters_sql(text)} AS v FROM {what}),
scored_{what} AS (SELECT query_id, {key}, CASE WHEN list_sum(k.v) = 0 OR list_sum(a.v) = 0 THEN 0.0 ELSE list_dot_product(k.v, a.v) / sqrt(list_dot_product(k.v, k.v)) / sqrt(list_dot_product(a.v, a.v)) END AS score FROM asked_{what} a CROSS JOIN known_{what} k),
near_{what} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, {key}) AS INTEGER) AS rank FROM scored_{what} QUALIFY rank <= {k})"""


_TEXTS = f"{_CHUNKS}, known_chunks AS (SELECT chunk_id, text FROM first_chunks WHERE text IS NOT NULL)"
_HOP = "reached AS (SELECT query_id, node_id FROM seeds UNION SELECT query_id, dst FROM seeds JOIN edges ON src = node_id), line AS (SELECT e.query_id, x.label || ' --[' || coalesce(relation_type, 'related_to') || ']--> ' || y.label AS line FROM edges JOIN reached e ON e.node_id = src JOIN reached f ON f.node_id = dst AND f.query_id = e.query_id JOIN nodes x ON x.node_id = src JOIN nodes y ON y.node_id = dst)"


def _vectors(spark, d, embed=_letters) -> DataFrame:
    return R.embedded(_chunks(spark, d).where("text is not null"), "chunk_id", "text", "chunk_id", embed)


@query(f"WITH {_TEXTS}, {_QUESTIONS}, {_nearest('known_chunks', 'chunk_id', 'text', 5)} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM near_known_chunks")
def search_vector(spark, d):
    found = R.vector_search(_questions(spark, d), _vectors(spark, d), embed=_letters)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_FULL}, {_TEXTS}, {_QUESTIONS}, {_nearest('known_chunks', 'chunk_id', 'text', 5)},
about AS (SELECT DISTINCT chunk AS chunk_id, lower(unnest([source, target])) AS node_id FROM relation_row WHERE source <> '' AND target <> '' AND chunk <> ''),
seeds AS (SELECT DISTINCT query_id, node_id FROM near_known_chunks JOIN about USING (chunk_id)), {_HOP},
part AS (SELECT query_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) FILTER (WHERE coalesce(text, '') <> '') AS texts FROM near_known_chunks JOIN first_chunks USING (chunk_id) GROUP BY query_id),
told AS (SELECT query_id, string_agg(line, chr(10) ORDER BY line) AS lines FROM line GROUP BY query_id)
SELECT query_id, md5(coalesce(concat_ws(chr(10) || chr(10), texts, lines), '')) AS digest FROM question LEFT JOIN part USING (query_id) LEFT JOIN told USING (query_id)""")
def search_local(spark, d):
    """The contexts of local search, as digests."""
    nodes, edges = _graph(spark, d)
    found = R.local_search(_questions(spark, d), _vectors(spark, d), G.chunk_entities(_extractions(spark, d), _order()), nodes, edges, embed=_letters)
    return R.contexts(_questions(spark, d), _chunks(spark, d), found).select("query_id", F.md5("context").alias("digest"))


@query(f"WITH {_FULL}, {_QUESTIONS}, {_nearest('nodes', 'node_id', 'label', 5)}, seeds AS (SELECT query_id, node_id FROM near_nodes), {_HOP} SELECT query_id, line FROM line")
def search_graph_only(spark, d):
    nodes, edges = _graph(spark, d)
    return R.graph_only_search(_questions(spark, d), nodes, edges, embed=_letters)["context"].select("query_id", "line")


_SUMMARIES = """top AS (SELECT community, size, label, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node_id) AS rank FROM member JOIN degree USING (node_id) JOIN nodes USING (node_id)),
summaries AS (SELECT community AS community_id, 'A community of ' || size || ' entities around ' || string_agg(label, ', ' ORDER BY rank) || '.' AS summary FROM top WHERE rank <= 5 GROUP BY community, size)"""


@query(f"{_PARTS}, {_SUMMARIES}, {_QUESTIONS}, {_nearest('summaries', 'community_id', 'summary', 3)} SELECT query_id, community_id, round(score, 6) AS score, rank, summary FROM near_summaries JOIN summaries USING (community_id)")
def search_global(spark, d):
    """Global search over the summaries of the connected parts."""
    nodes, edges, members = _parts(spark, d)
    known = cut(CO.community_table(members, CO.summarise(members, nodes, edges)))
    found = R.global_search(_questions(spark, d), known, embed=_letters)["summaries"]
    return found.select("query_id", "community_id", F.round("score", 6).alias("score"), "rank", "summary")


def _communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    members = cut(CO.detect(nodes, edges))
    return cut(CO.community_table(members, CO.summarise(members, nodes, edges)))


@query()
def search_hybrid(spark, d):
    nodes, edges = _graph(spark, d)
    found = R.hybrid_search(_questions(spark, d), _vectors(spark, d, V.hashed_embedding), G.chunk_entities(_extractions(spark, d), _order()), nodes, edges, _communities(nodes, edges))
    asked = R.contexts(_questions(spark, d), _chunks(spark, d), found)
    return R.extractive_answers(cut(asked))


# --- evaluation ----------------------------------------------------------------------

_JUDGED = "judged AS (SELECT r.record_id, r.top_k, CAST(r.retrieved_chunk_ids AS VARCHAR[]) AS chunks, q.relevant_doc_ids AS relevant FROM records r JOIN (SELECT trim(question) AS question, min(question_id) AS question_id FROM eval_questions GROUP BY ALL) k ON k.question = trim(r.question) JOIN eval_questions q USING (question_id))"


def _judged(spark, d) -> DataFrame:
    keys = table(spark, d, "eval_questions").groupBy(F.trim("question").alias("q")).agg(F.min("question_id").alias("question_id"))
    asked = keys.join(table(spark, d, "eval_questions"), "question_id").select("q", "relevant_doc_ids", "reference_answer")
    rows = _records(spark, d).withColumn("q", F.trim("question")).withColumn("chunks", F.from_json("retrieved_chunk_ids", "array<string>"))
    return rows.join(F.broadcast(asked), "q")


def _metrics_sql(ids: str) -> str:
    return f"""
WITH {_RECORDS}, {_JUDGED}, m AS (SELECT record_id, top_k, {ids} AS ids, coalesce(relevant, []) AS relevant FROM judged),
h AS (SELECT *, len(list_filter(ids[1:top_k], lambda x: list_contains(relevant, x))) AS hits, list_min(list_transform(list_filter(range(1, len(ids) + 1), lambda i: list_contains(relevant, ids[i])), lambda i: i)) AS first FROM m)
SELECT record_id, CAST(hits AS INTEGER) AS hits, round(CASE WHEN len(ids) = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / top_k END, 6) AS precision_k, round(CASE WHEN len(relevant) = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / len(list_distinct(relevant)) END, 6) AS recall_k, round(CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 / first END, 6) AS mrr FROM h
"""


def _retrieval_metrics(rows: DataFrame, ids) -> DataFrame:
    rows = rows.withColumn("ids", ids)
    k = F.col("top_k")
    hits = F.size(F.filter(F.slice("ids", F.lit(1), k), lambda x: F.array_contains(F.coalesce("relevant_doc_ids", F.array().cast("array<string>")), x)))
    n = F.size(F.array_distinct(F.coalesce("relevant_doc_ids", F.array().cast("array<string>"))))
    return rows.select(
        "record_id", hits.alias("hits"), F.round(hits / k, 6).alias("precision_k"), F.round(F.when(n > 0, hits / n).otherwise(0.0), 6).alias("recall_k"), F.round(M.reciprocal_rank(F.col("ids"), F.col("relevant_doc_ids")), 6).alias("mrr")
    )


@query(_metrics_sql("list_transform(chunks, lambda x: split_part(x, '__', 1))").replace("AS ids,", "AS raw,").replace(f"h AS (SELECT *", "u AS (SELECT *, list_transform(list_filter(range(1, len(raw) + 1), lambda i: list_position(raw, raw[i]) = i), lambda i: raw[i]) AS ids FROM m), h AS (SELECT *").replace("FROM m)\nSELECT", "FROM u)\nSELECT"))
def retrieval_metrics(spark, d):
    """Against documents: each document at its first rank."""
    return _retrieval_metrics(_judged(spark, d), M.as_documents(F.col("chunks")))


@query(_metrics_sql("chunks"))
def retrieval_metrics_chunk(spark, d):
    """Against the ids as they are."""
    return _retrieval_metrics(_judged(spark, d), F.col("chunks"))


@query()
def answer_rouge(spark, d):
    rows = _judged(spark, d).where("reference_answer is not null and reference_answer <> ''")
    return rows.select("record_id", M.rouge_scores("answer", "reference_answer").alias("s")).select("record_id", "s.rouge1", "s.rougel")


_AVERAGES = ", ".join(f"round(avg(coalesce({c}, 0)), 6) AS {c}" for c in ("rouge1", "rougel", *B.QUALITY, "precision_5", "recall_5", "mrr", "latency_s", "context_char_count"))
_FALLBACK = " OR ".join("contains(trim(lower(coalesce(answer, ''))), '{}')".format(p.replace("'", "''")) for p in B.FALLBACK_PATTERNS)
_RATES = rf"round(avg(CASE WHEN {_FALLBACK} THEN 1.0 ELSE 0.0 END), 6) AS fallback_rate, round(avg(CASE WHEN regexp_replace(coalesce(answer, ''), '[\s\pZ\x1c-\x1f\x85]+', '', 'g') = '' THEN 1.0 ELSE 0.0 END), 6) AS empty_rate"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(f"WITH {_RECORDS} SELECT pipeline, count(*) AS n_rows, {_AVERAGES}, {_RATES} FROM records GROUP BY pipeline")
def benchmark_by_pipeline(spark, d):
    return _rounded(B.aggregates(_records(spark, d), "pipeline"))


@query(f"WITH {_RECORDS} SELECT pipeline, CASE WHEN trim(lower(question_scope)) IN ('local', 'global') THEN trim(lower(question_scope)) ELSE 'local' END AS question_scope, count(*) AS n_rows, {_AVERAGES}, {_RATES} FROM records GROUP BY ALL")
def benchmark_by_scope(spark, d):
    return _rounded(B.aggregates(_records(spark, d).withColumn("question_scope", M.scope(F.col("question_scope"))), "pipeline", "question_scope"))


_UNIT = ", ".join(f"greatest(0.0, least(1.0, coalesce({c}, 0.0))) AS {c}" for c in M.UNIT_METRICS)


@query(f"WITH {_RECORDS} SELECT record_id, {_UNIT}, CASE WHEN trim(lower(question_scope)) IN ('local', 'global') THEN trim(lower(question_scope)) ELSE 'local' END AS question_scope, greatest(1, coalesce(top_k, 1)) AS top_k, coalesce(relevant_hits_at_k, 0) > 0 AS has_relevant_hit_at_k FROM records")
def records_validated(spark, d):
    return _records(spark, d).withColumns(M.validated()).select("record_id", *M.UNIT_METRICS, "question_scope", "top_k", "has_relevant_hit_at_k")


_TIERS = {"judges": B.QUALITY, "efficiency": ("latency_s", "context_char_count"), "retrieval": ("precision_5", "recall_5", "mrr")}
_TIER_SQL = " UNION ALL ".join(f"SELECT '{t}' AS tier, concat_ws(', ', {', '.join(f'CASE WHEN max(coalesce({c}, 0)) > 0 THEN {chr(39)}{c}{chr(39)} END' for c in cs)}) AS active FROM records" for t, cs in _TIERS.items())


@query(f"WITH {_RECORDS} SELECT tier, active <> '' AS available, active FROM ({_TIER_SQL})")
def benchmark_tiers(spark, d):
    return B.tiers(_records(spark, d))


@query(f"WITH {_RECORDS}, s AS (SELECT record_id, coalesce(rouge1, 0.0) AS rouge1 FROM records) SELECT * FROM (SELECT 'best' AS example, record_id, rouge1 FROM s ORDER BY rouge1 DESC, record_id DESC LIMIT 1) UNION ALL SELECT * FROM (SELECT 'worst', record_id, rouge1 FROM s ORDER BY rouge1, record_id LIMIT 1)")
def benchmark_extremes(spark, d):
    return B.extremes(_records(spark, d))


_LEADING = {"highest_fallback": ("fallback_rate", "DESC"), "lowest_latency": ("latency_s", ""), "largest_context": ("context_char_count", "DESC"), "best_rouge1": ("rouge1", "DESC"), "best_faithfulness": ("faithfulness", "DESC")}
_LEAD_SQL = " UNION ALL ".join(f"(SELECT '{n}' AS what, pipeline, round({c}, 6) AS value FROM s ORDER BY {c} {o}, pipeline {o} LIMIT 1)" for n, (c, o) in _LEADING.items())


@query(f"WITH {_RECORDS}, s AS (SELECT pipeline, {_AVERAGES.replace('round(', '(').replace(', 6)', ')')}, {_RATES.replace('round(', '(').replace(', 6)', ')')} FROM records GROUP BY pipeline) {_LEAD_SQL}")
def benchmark_leaders(spark, d):
    return _rounded(B.leaders(B.aggregates(_records(spark, d), "pipeline")))


@query(f"WITH {_RECORDS}, e AS (SELECT trim(question) AS q, pipeline, avg(coalesce(rouge1, 0)) AS v FROM records GROUP BY ALL), b AS (SELECT q, v AS b FROM e WHERE pipeline = 'rag') SELECT pipeline, sum(CASE WHEN v - b > 1e-9 THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN v - b < -1e-9 THEN 1 ELSE 0 END) AS losses, sum(CASE WHEN abs(v - b) <= 1e-9 THEN 1 ELSE 0 END) AS ties FROM e JOIN b USING (q) WHERE pipeline <> 'rag' GROUP BY pipeline")
def benchmark_head_to_head(spark, d):
    return B.head_to_head(_records(spark, d), "rouge1")


@query(f"WITH {_RECORDS} SELECT record_id, concat_ws(' ', CASE WHEN coalesce(faithfulness, 0) < 0.5 AND coalesce(relevant_hits_at_k, 0) = 0 THEN 'Low faithfulness aligns with no relevant retrieval hit in top-k.' END, CASE WHEN coalesce(relevant_hits_at_k, 0) > 0 AND coalesce(faithfulness, 0) < 0.4 THEN 'Potential contradiction: relevant hit exists but faithfulness is low.' END) AS notes FROM records")
def benchmark_judge_notes(spark, d):
    return _records(spark, d).select("record_id", B.judge_notes(F.col("faithfulness"), F.col("relevant_hits_at_k")).alias("notes"))


_NOTES = "concat_ws(' ', CASE WHEN coalesce(faithfulness, 0) < 0.5 AND coalesce(relevant_hits_at_k, 0) = 0 THEN 'Low faithfulness aligns with no relevant retrieval hit in top-k.' END, CASE WHEN coalesce(relevant_hits_at_k, 0) > 0 AND coalesce(faithfulness, 0) < 0.4 THEN 'Potential contradiction: relevant hit exists but faithfulness is low.' END)"


@query(f"""WITH {_RECORDS}, r AS (SELECT *, CAST(retrieved_chunk_ids AS VARCHAR[])[1:5] AS ids FROM records)
SELECT coalesce(question_scope, 'local') AS question_scope, question, pipeline, search_mode, answer, coalesce(array_to_string(list_transform(ids, lambda x, i: i || '. ' || x), chr(10)), '') AS top_k_chunks, retrieved_count, relevant_hits_at_k,
       {', '.join(f'round(coalesce({c}, 0.0), 6) AS {c}' for c in ('precision_5', 'recall_5', 'mrr', *B.QUALITY, 'latency_s'))}, {_NOTES} AS judge_validation_notes FROM r""")
def benchmark_review(spark, d):
    return _rounded(B.review(_records(spark, d)))


@query("WITH q AS (SELECT question_id, trim(question) AS question, trim(coalesce(reference_answer, '')) AS reference_answer, CASE WHEN trim(lower(question_scope)) IN ('local', 'global') THEN trim(lower(question_scope)) ELSE 'local' END AS question_scope, len(list_filter(coalesce(relevant_doc_ids, []), lambda x: trim(x) <> '')) AS n_relevant FROM eval_questions WHERE trim(coalesce(question, '')) <> '') SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lower(question) ORDER BY question_id) = 1")
def questions_normalised(spark, d):
    return B.questions_of(table(spark, d, "eval_questions")).select("question_id", "question", "reference_answer", "question_scope", F.size("relevant_doc_ids").cast("long").alias("n_relevant"))


@query(f"WITH {_RECORDS} SELECT record_id, strftime(CAST(replace(replace(timestamp_utc, 'Z', ''), '+00:00', '') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS at FROM records")
def record_times(spark, d):
    return _records(spark, d).select("record_id", F.date_format(F.to_timestamp(F.regexp_replace("timestamp_utc", r"(Z|\+00:00)$", "")), "yyyy-MM-dd HH:mm:ss").alias("at"))
