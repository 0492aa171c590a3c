"""Problem 8: the corpus as ids of a public byte-level BPE vocabulary.

A text longer than ``CHUNK`` characters is cut into chunks that overlap by
``OVERLAP`` characters, and each is pre-tokenised on its own. Neighbours are
stitched at the first position of the overlap where both start a pre-token and
the character before is no white space (there the tokenisation no longer depends
on what came before or after). Where a pre-token spans a whole overlap, the next
chunk goes on from the last certain boundary; the pre-token itself is looked
through once more for each doubling of its length only. The pieces between the
stitches are then encoded. Shorter texts are one piece. There is no shuffle:
every row stays in its task.

Defined results: null and empty texts give the empty list; a string that looks
like a special token is plain text; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scholaspark.llm.common import table
from scholaspark.operators import chunking

#: Folder of the vocabulary files, and the vocabulary's file.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK = 8192
OVERLAP = 512

def encoding(directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY):
    return chunking.encoding(directory, vocabulary)


@lru_cache(maxsize=1)
def _pretoken():
    import regex

    return regex.compile(chunking.PATTERN)


def _starts(text: str, begin: int, end: int) -> list[int]:
    return [m.start() for m in _pretoken().finditer(text[begin:end])]


def pieces(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The text in pieces that can be encoded one by one."""
    size = len(text)
    if size <= chunk:
        return [text]
    begins = range(0, size, chunk)
    starts = [[b + s for s in _starts(text, b, min(size, b + chunk + overlap))] for b in begins]
    cuts = [0]
    current = starts[0]
    open_until = 0
    for number in range(1, len(begins)):
        begin, after = begins[number], starts[number]
        if begin < open_until:
            # Still inside the part that was looked through again.
            continue
        mine = {s for s in current if begin < s and not text[s - 1].isspace()}
        at = next((s for s in after if s < begin + overlap and s in mine), None)
        if at is None:
            # No resynchronisation: go on from the last certain boundary, twice
            # as far as before.
            last = current[-1] if current else cuts[-1]
            end = min(size, max(begin + chunk, last + 2 * (begin + overlap - last)) + overlap)
            current = [s for s in current if s < last] + [last + s for s in _starts(text, last, end)]
            open_until = end - chunk - overlap
        else:
            cuts.append(at)
            current = [s for s in after if s >= at]
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], size])]


def encode_texts(texts: list[str | None], directory: str, vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[list[int]]:
    core = encoding(directory, vocabulary).encode_ordinary
    found = []
    for text in texts:
        if not text:
            found.append([])
        elif len(text) <= chunk:
            found.append(core(text))
        else:
            found.append([i for piece in pieces(text, chunk, overlap) for i in core(piece)])
    return found


def raw_bytes(ids: list[int], directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> bytes:
    """The raw bytes of the ids, joined."""
    single = encoding(directory, vocabulary).decode_single_token_bytes
    return b"".join(map(single, ids))


def decode_ids(ids: list[int], directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> str:
    """The text of the ids: their raw bytes read as UTF-8."""
    return raw_bytes(ids, directory, vocabulary).decode("utf-8")


def encode(df: DataFrame, key: str, text: str, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids): the ids of each row's text; other columns are dropped."""
    source = df.select(df[key].alias("item_key"), df[text].alias("item_text"))
    kind = source.schema["item_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                ids = encode_texts(part.column(1).to_pylist(), directory, vocabulary, chunk, overlap)
                offsets = [0]
                for x in ids:
                    offsets.append(offsets[-1] + len(x))
                flat = pa.array([i for x in ids for i in x], pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["item_key", "ids"])

    return source.mapInArrow(run, f"item_key {kind}, ids array<int>").withColumnRenamed("item_key", key)


def p8_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, digest, n_bytes): of the texts that the ids give when decoded."""
    source = encode(table(spark, sf_dir, "documents"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [raw_bytes(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.md5(r).hexdigest() for r in raw], pa.string()), pa.array([len(r) for r in raw], pa.int64())], ["doc_id", "digest", "n_bytes"])

    return source.mapInArrow(run, "doc_id long, digest string, n_bytes long")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids, "p8_texts": p8_texts}
SQL = {"p8_texts": "SELECT doc_id, md5(coalesce(text, '')) AS digest, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents"}
