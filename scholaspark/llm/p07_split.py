"""Problem 7: oversized texts in numbered pieces, cut at natural boundaries.

Dynamic programming over boundary positions. The candidate cuts of a text are
its paragraph ends, line ends, sentence ends and clause ends; between two of
them that lie more than a step apart, also the word gaps, and where even these
are too far apart, every step-th character. A step is ``COARSE`` characters, or
what a piece may gain on the one before if that is less. Each kind has a penalty. A piece runs from its cut, moved back by the overlap, to the
next cut and has at most ``limit`` characters. The cuts chosen minimise the
sum of the penalties and of the squared departures of the pieces' sizes from
the mean size of the least number of pieces. The overlap is the last
``overlap`` characters of the piece before, or fewer, to begin at a word.

The work is per row and map-only; a piece is cut where its text is. Defined
results: null, empty and blank texts of at most the limit give no piece;
repeated keys give their pieces once in ``p7_found``; ties take the earliest
cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholaspark.llm.common import table
from scholaspark.operators.documents import first_loads

LIMIT = 2000
OVERLAP = 200
#: Largest distance between candidate cuts before a finer kind is used.
COARSE = 240
#: Penalty of a cut by its kind; a size wholly off the mean costs 1.
PARAGRAPH, LINE, SENTENCE, CLAUSE, GAP, ANYWHERE = 0.0, 0.15, 0.2, 0.5, 0.8, 3.0

_STRONG = re.compile(r"(?P<p>\n[^\S\n]*\n\s*|\r\n[^\S\n]*\r\n\s*)|(?P<l>\r?\n)|(?P<s>[.!?…][\"”»')\]]*\s+|[。！？])|(?P<c>[,;:]\s+|[，；：、])")
_GAP = re.compile(r"\s+")
_PENALTY = {"p": PARAGRAPH, "l": LINE, "s": SENTENCE, "c": CLAUSE}


def candidates(text: str, coarse: int = COARSE) -> tuple[list[int], list[float]]:
    """Positions where a piece may end, with penalties; the last is the end.
    Neighbours are at most ``coarse`` characters apart."""
    at, cost = [0], [0.0]

    def fill(end: int) -> None:
        begin = at[-1]
        if end - begin <= coarse:
            return
        for m in _GAP.finditer(text, begin + 1, end):
            if m.end() - at[-1] > coarse:
                hard(m.end())
            if at[-1] < m.end() < end:
                at.append(m.end())
                cost.append(GAP)
        hard(end)

    def hard(end: int) -> None:
        while end - at[-1] > coarse:
            at.append(at[-1] + coarse)
            cost.append(ANYWHERE)

    for m in _STRONG.finditer(text):
        end = m.end()
        if end >= len(text):
            break
        fill(end)
        if end > at[-1]:
            at.append(end)
            cost.append(_PENALTY[m.lastgroup])
    fill(len(text))
    at.append(len(text))
    cost.append(0.0)
    return at, cost


def begin_of(text: str, cut: int, overlap: int) -> int:
    """Where the piece after ``cut`` begins: at most ``overlap`` before it,
    at a word's start if there is one in between."""
    first = cut - overlap
    if first <= 0 or overlap <= 0:
        return max(first, 0) if overlap > 0 else cut
    if text[first - 1].isspace() and not text[first].isspace():
        return first
    m = _GAP.search(text, first, cut)
    return m.end() if m and m.end() < cut else first


def split(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(begin, end) of the pieces; none for texts within the limit."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and below the limit")
    if text is None or len(text) <= limit:
        return []
    at, cost = candidates(text, min(COARSE, limit - overlap))
    begins = [0] + [begin_of(text, c, overlap) for c in at[1:-1]]
    size = len(text)
    # The number of pieces whose mean size, overlap counted, is within the limit.
    count = -(-(size - overlap) // (limit - overlap))
    mean = (size + overlap * (count - 1)) / count
    best = [0.0] + [float("inf")] * (len(at) - 1)
    came = [0] * len(at)
    first = 0
    for j in range(1, len(at)):
        end = at[j]
        while end - begins[first] > limit:
            first += 1
        found, where = float("inf"), first
        for i in range(first, j):
            off = (end - begins[i]) / mean - 1.0
            value = best[i] + off * off
            if value < found:
                found, where = value, i
        best[j], came[j] = found + cost[j], where
    cuts, j = [], len(at) - 1
    while j:
        cuts.append((begins[came[j]], at[j]))
        j = came[j]
    return cuts[::-1]


def split_texts(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_key, index, begin, end, piece) of each text above the limit.

    ``begin`` and ``end`` count code points from 0; ``index`` goes up from 0.
    """
    # The filter is a plain expression on the text and drops what has no piece
    # before anything leaves the JVM.
    source = df.select(df[key].cast("string").alias("item_key"), df[text].alias("item_text")).where(F.length("item_text") > limit)
    names = ["item_key", "index", "begin", "end", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                keys, index, begin, end, piece = [], [], [], [], []
                part = batch.slice(first, 256)
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for i, (a, b) in enumerate(split(t, limit, overlap)):
                        keys.append(k)
                        index.append(i)
                        begin.append(a)
                        end.append(b)
                        piece.append(t[a:b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), pa.array(index, pa.int32()), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(piece, pa.string())], names
                )

    return source.mapInArrow(run, "item_key string, index int, begin int, end int, piece string")


def _pieces(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    documents, chunks = split_texts(documents, "doc_id", "text"), split_texts(chunks, "chunk_id", "text")
    named = lambda df, name: df.select(F.lit(name).alias("table_name"), "*")
    return named(documents, "documents").unionByName(named(chunks, "chunks"))


def rebuilt(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, digest, pieces, longest, overlap) of split texts: the MD5 of the
    text that the pieces give when each is freed of what it repeats, their number,
    and the greatest size and overlap. What index to what index is checked too: a
    gap among the indexes or between the pieces leaves the digest null."""
    parts = F.array_sort(F.collect_list(F.struct("index", "begin", "end", "piece")))
    before = lambda i: F.get(F.col("parts"), i - 1)["end"]
    fresh = F.transform("parts", lambda p, i: F.when((p["index"] == i) & (F.coalesce(before(i), F.lit(0)) >= p["begin"]), F.substr(p["piece"], F.coalesce(before(i), F.lit(0)) - p["begin"] + 1)))
    whole = F.when(F.forall(fresh, lambda x: x.isNotNull()), F.md5(F.array_join(fresh, "")))
    overlaps = F.transform("parts", lambda p, i: F.coalesce(before(i), F.lit(0)) - p["begin"])
    rows = pieces.groupBy(*keys).agg(parts.alias("parts"))
    return rows.select(*keys, whole.alias("digest"), F.size("parts").alias("pieces"), F.array_max(F.transform("parts", lambda p: F.length(p["piece"]))).alias("longest"), F.array_max(overlaps).alias("overlap"))


def _once(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = (("documents", "doc_id"), ("chunks", "chunk_id"))
    rows = (first_loads(table(spark, sf_dir, t).select(k, "text", "ingested_at"), [k], [F.col("ingested_at"), F.xxhash64("text")]) for t, k in named)
    return _pieces(*rows)


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece; of repeated loads those of the first."""
    return _once(spark, sf_dir)


def p7_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every split text, whether its pieces keep what is asked of them."""
    rows = rebuilt(_once(spark, sf_dir), ["table_name", "item_key"])
    return rows.select("table_name", "item_key", "digest", (F.col("longest") <= LIMIT).alias("within"), F.col("overlap").between(0, OVERLAP).alias("overlaps"), (F.col("pieces") > 1).alias("several"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of the texts that were cut. Each is the key of a second piece."""
    pieces = _pieces(*(table(spark, sf_dir, t) for t in ("documents", "chunks")))
    return pieces.where(F.col("index") == 1).select("table_name", "item_key").distinct()


QUERIES = {"p7_pieces": p7_pieces, "p7_rebuilt": p7_rebuilt, "p7_found": p7_found}
SQL = {
    "p7_rebuilt": """
SELECT 'documents' AS table_name, CAST(doc_id AS VARCHAR) AS item_key, md5(text) AS digest, TRUE AS within, TRUE AS overlaps, TRUE AS several FROM documents WHERE length(text) > 2000
UNION
SELECT 'chunks', chunk_id, md5(text), TRUE, TRUE, TRUE FROM chunks WHERE length(text) > 2000
""",
    "p7_found": """
SELECT DISTINCT 'documents' AS table_name, CAST(doc_id AS VARCHAR) AS item_key FROM documents WHERE length(text) > 2000
UNION
SELECT DISTINCT 'chunks' AS table_name, chunk_id AS item_key FROM chunks WHERE length(text) > 2000
"""
}
