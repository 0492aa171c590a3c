"""Documents: records from texts, first-load rules, search, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholaspark.functions import text as T


#: Places (as a power of two) of the bit map of keys that come again.
MAP_BITS = 25


def first_loads(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order.

    Rows of a null key are one key. The order should be total; rows that tie in
    it are alike for the caller. Few keys come again, so only the hashes of the
    keys are shuffled first: those met twice mark a bit map of fixed size (at most
    8 MB, whatever the data's size), and only the rows on marked places, the
    repeated ones and a few others, are ranked; all others go through as they lie.
    ``df`` is read three times, once for its keys only, so it should be a table
    and not the result of much work.
    """
    slot = lambda h: h.bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    again = df.select(F.xxhash64(*keys).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    marked = again.select(F.shiftright(slot(F.col("h")), 6).alias("_place"), bit.alias("bits")).groupBy("_place").agg(F.expr("bit_or(bits)").alias("_bits"))
    placed = df.withColumn("_hash", F.xxhash64(*keys)).withColumn("_place", F.shiftright(slot(F.col("_hash")), 6)).join(F.broadcast(marked), "_place", "left")
    hit = F.expr("coalesce(_bits & shiftleft(1L, cast(_hash & 63 as int)), 0L) <> 0L")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = placed.where(hit).withColumn("_rank", rank).where("_rank = 1")
    return placed.where(~hit).select(*df.columns).unionByName(ranked.select(*df.columns))


def records_from_text(raw: DataFrame) -> DataFrame:
    """Paper records from (doc_id, text, source_file): title, abstract, authors,
    year and sections are guessed; the full text is lightly cleaned."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return raw.select(
        "doc_id",
        T.title_of(t).alias("title"),
        T.authors_of(t).alias("authors"),
        T.abstract_of(t).alias("abstract"),
        F.array().cast("array<string>").alias("categories"),
        T.year_of(F.col("doc_id"), t).alias("year"),
        T.reading_text(t).alias("full_text"),
        T.sections_of(t).alias("sections"),
        "source_file",
    )


def documents_from_records(records: DataFrame) -> DataFrame:
    """The reading view of paper records: absent fields become empty."""
    none = F.array().cast("array<string>")
    return records.select(
        "doc_id",
        F.coalesce("full_text", F.lit("")).alias("text"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("abstract", F.lit("")).alias("abstract"),
        F.coalesce("authors", none).alias("authors"),
        F.coalesce("categories", none).alias("categories"),
        "year",
        "sections",
        F.coalesce("source_file", F.lit("")).alias("source_file"),
    )


def search_by_title(documents: DataFrame, query: str, top_n: int = 10) -> DataFrame:
    """Documents whose title holds the query, whatever its case; earlier matches
    first, then by id. ``position`` counts from 0."""
    at = F.instr(F.lower("title"), query.lower())
    found = documents.withColumn("position", at - 1).where(at > 0)
    return found.orderBy("position", "doc_id").limit(top_n)


def search_by_metadata(documents: DataFrame, year: int | None = None, category: str | None = None, author: str | None = None) -> DataFrame:
    """Documents that meet all given conditions; category and author match as
    parts of a value, whatever their case."""
    found = documents
    if year is not None:
        found = found.where(F.col("year") == year)
    for column, part in (("categories", category), ("authors", author)):
        if part is not None:
            found = found.where(F.exists(column, _holds(part)))
    return found


def _holds(part: str):
    return lambda x: F.lower(x).contains(part.lower())


def not_indexed(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents whose id isn't in the manifest (resume)."""
    return documents.join(manifest.select("doc_id"), "doc_id", "left_anti")


def manifest_of(documents: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """The manifest after these documents are indexed."""
    ids = documents.select("doc_id")
    return (ids if manifest is None else ids.unionByName(manifest.select("doc_id"))).where("doc_id is not null").distinct()
