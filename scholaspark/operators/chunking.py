"""Token windows: overlapping chunks of texts."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholaspark.config import get_settings
from scholaspark.functions import text as T

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(directory: str, vocabulary: str):
    import tiktoken

    pairs = map(bytes.split, Path(directory, vocabulary).read_bytes().splitlines())
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def windows(n_tokens: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) of the windows over so many tokens."""
    return [(i, min(i + size, n_tokens)) for i in range(0, n_tokens, size - overlap)]


def metadata_of(documents: DataFrame) -> Column:
    """What a chunk tells of its document: title, doc_id, file and the headings of
    its sections, each where it is known. A ``metadata`` map of the documents
    comes last, so its values stand where keys clash."""
    there = documents.columns
    pairs = [F.struct(F.lit("title").alias("key"), F.coalesce(documents["title"], F.lit("")).alias("value")), F.struct(F.lit("doc_id").alias("key"), documents["doc_id"].cast("string").alias("value"))]
    if "source_file" in there:
        pairs.append(F.struct(F.lit("source_file").alias("key"), documents["source_file"].alias("value")))
    if "sections" in there:
        pairs.append(F.struct(F.lit("sections").alias("key"), F.to_json(F.col("sections.heading")).alias("value")))
    known = F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"].isNotNull()))
    if "metadata" not in there:
        return known
    own = F.coalesce(documents["metadata"], F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(known, lambda k, v: ~F.map_contains_key(own, k)), own)


def chunk(documents: DataFrame, size: int | None = None, overlap: int | None = None, directory: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """(chunk_id, doc_id, text, index, n_tokens, title, metadata) of each
    document's windows. Null and empty texts have none. Map-only: a document's
    windows are made where its text is."""
    s = get_settings()
    size, overlap = size or s.chunk_size, s.chunk_overlap if overlap is None else overlap
    directory, vocabulary = directory or s.tokenizer_dir, vocabulary or s.tokenizer_vocabulary
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and below the chunk size")
    source = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.coalesce(documents["title"], F.lit("")).alias("title"), metadata_of(documents).alias("metadata"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(directory, vocabulary)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                at, rows = [], []
                for number, t in enumerate(part.column("text").to_pylist()):
                    tokens = coder.encode_ordinary(t) if t else []
                    for i, (a, b) in enumerate(windows(len(tokens), size, overlap)):
                        at.append(number)
                        rows.append((coder.decode(tokens[a:b]), i, b - a))
                own = part.take(pa.array(at, pa.int32()))
                columns = [pa.array(list(c), k) for c, k in zip(list(zip(*rows)) or [[]] * 3, (pa.string(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), *columns, own.column("title"), own.column("metadata")], ["doc_id", "text", "index", "n_tokens", "title", "metadata"])

    made = source.mapInArrow(run, "doc_id string, text string, index int, n_tokens int, title string, metadata map<string,string>")
    return made.select(T.chunk_id(F.col("doc_id"), F.col("index")).alias("chunk_id"), "doc_id", "text", "index", "n_tokens", "title", "metadata")


def prepare_and_chunk(documents: DataFrame, **options) -> DataFrame:
    """The chunking pipeline: texts are cleaned, then cut into windows."""
    return chunk(documents.withColumn("text", T.prepared(F.col("text"))), **options)


def token_counts(df: DataFrame, key: str, text: str, directory: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """(key, n_tokens): the token estimate of a context; 0 for null and empty."""
    s = get_settings()
    directory, vocabulary = directory or s.tokenizer_dir, vocabulary or s.tokenizer_vocabulary
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(directory, vocabulary)
        for batch in batches:
            counts = [len(coder.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], [key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens int")
