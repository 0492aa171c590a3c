"""Problem 9: passages of held-out items in training texts.

Every window of ``WORDS`` words of a text or an item is a string of symbols,
one to a word. A CGK random walk embeds it in ``3 * WORDS`` symbols: at each
step the symbol under the pointer is put out, and a random bit of (step,
symbol) says whether the pointer moves on. Windows of small edit distance get
embeddings of small Hamming distance, equal windows equal ones. There are
``WALKS`` independent walks, and each of the ``TABLES`` hash tables of a walk
samples ``BITS`` positions of its embedding; windows of a text that collide with
an item's window in any table are candidates, and the edit distance of the words
decides. Equal windows collide in every table, so the exact matches are complete;
of single windows with one edit 0.99 are found, of those with two 0.96 (asserted
in the tests).

An edit changes at most two of a window's pairs of neighbouring words, so a
window within ``EDITS`` edits has all but ``2 * EDITS`` of its pairs in common
with an item. Windows with fewer pairs known from any item aren't embedded; that
loses nothing.

Texts are read once and never shuffled. Up to ``BLOCK_WINDOWS`` item windows
go to every task. More items stay where they are: their pairs of
words become a bit map of fixed size, and the keys of their windows are joined
with those of the windows of the texts.

Defined results: null, empty and blank texts and items, and items of fewer
words than a window, match nothing; repeated rows count once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholaspark.llm.common import BROADCAST_LIMIT, WORD, table, written

WORDS = 13
EDITS = 2
WALKS = 4
TABLES = 8
BITS = 5
SEED = 20240917
#: Most windows of items that are sent to every task.
BLOCK_WINDOWS = 50_000
#: Bits (as a power of two) of the map of the items' pairs of words.
MAP_BITS = 24

_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _is_word() -> np.ndarray:
    """By code point: 1 for letters and digits."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), np.bool_, 0x110000)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(x))])) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


@lru_cache(maxsize=4)
def _walk(words: int, walks: int, tables: int, bits: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each walk: odd multipliers of each step's random bit, and of each
    table's samples.

    The pointer moves at every other step on average, so the samples are taken
    from the first ``2 * words`` steps; later ones mostly put out the padding.
    """
    rng = np.random.default_rng(seed)
    odd = lambda n: rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    found = []
    for _ in range(walks):
        turn = odd(3 * words)
        sample = np.zeros((tables, 3 * words), np.uint64)
        for t in range(tables):
            sample[t, rng.choice(2 * words, min(bits, 2 * words), replace=False)] = odd(min(bits, 2 * words))
        found.append((turn, sample))
    return found


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its text) of every word of the texts, in lower case."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _is_word()[codes]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(1 << max(14, (len(codes) + 1).bit_length()))
    with np.errstate(over="ignore"):
        c = (codes.astype(np.uint64) + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93)
        c ^= c >> np.uint64(32)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(c * up[: len(c)])])
        found = (sums[end] - sums[begin]) * down[begin]
        found ^= found >> np.uint64(29)
        found *= np.uint64(0xA0761D6478BD642F)
        found ^= found >> np.uint64(32)
    sizes = np.fromiter(map(len, lower), np.int64, len(lower)) + 1
    return found, np.searchsorted(np.cumsum(sizes), begin, "right")


def embed(words: np.ndarray, at: np.ndarray, size: int = WORDS, walks: int = WALKS, tables: int = TABLES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """The tables' keys, a row each, of the windows of ``size`` words that begin
    at ``at``."""
    stop = at + size
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    keys = np.zeros((walks * tables, len(at)), np.uint64)
    with np.errstate(over="ignore"):
        for number, (turn, sample) in enumerate(_walk(size, walks, tables, bits, seed)):
            pointer = at.copy()
            used = np.flatnonzero(sample.any(axis=0))
            for step in range(used[-1] + 1):
                symbol = np.where(pointer < stop, padded[pointer], np.uint64(0))
                for t in np.flatnonzero(sample[:, step]):
                    keys[number * tables + t] += symbol * sample[t, step]
                pointer += ((symbol * turn[step]) >> np.uint64(63)).astype(np.int64)
                np.minimum(pointer, stop, out=pointer)
    return keys


def _starts(owner: np.ndarray, size: int) -> np.ndarray:
    """Where windows of ``size`` words begin that lie in one text."""
    at = np.arange(max(len(owner) - size + 1, 0))
    return at[owner[at] == owner[at + size - 1]] if len(at) else at


def _slots(found: np.ndarray) -> np.ndarray:
    """The places in the bit map of each word with the next."""
    with np.errstate(over="ignore"):
        pair = (found[:-1] * np.uint64(0x9FB21C651E98DF25)) ^ found[1:]
        return (pair * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - MAP_BITS)


def survivors(found: np.ndarray, owner: np.ndarray, size: int, edits: int, known: np.ndarray) -> np.ndarray:
    """The windows with all but 2 * edits of their pairs of words in the map."""
    at = _starts(owner, size)
    if not len(at):
        return at
    slots = _slots(found)
    hit = (known[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1
    sums = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
    return at[sums[at + size - 1] - sums[at] >= size - 1 - 2 * edits]


def bit_map(slots: np.ndarray) -> np.ndarray:
    flat = np.zeros(1 << MAP_BITS, bool)
    flat[slots.astype(np.int64)] = True
    return np.packbits(flat, bitorder="little")


def edit_distance(a: list[str], b: list[str], most: int) -> int:
    """Levenshtein distance of two word lists, or most + 1."""
    if a == b:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


class ItemBlock:
    """The windows of some items, by table and key."""

    def __init__(self, items: list[tuple[int, str]], words: int = WORDS, walks: int = WALKS, tables: int = TABLES, bits: int = BITS, seed: int = SEED):
        self.words, self.form = words, (walks, tables, bits, seed)
        self.lists = [(i, WORD.findall(t.lower())) for i, t in items]
        found, owner = symbols([t for _, t in items])
        at = _starts(owner, words)
        first = np.searchsorted(owner, np.arange(len(items)))
        self.symbols, self.at, self.owner, self.offset = found, at, owner[at], at - first[owner[at]]
        slots = _slots(found)[owner[:-1] == owner[1:]] if len(found) else np.zeros(0, np.uint64)
        self.known = np.unique(slots)
        keys = embed(found, at, words, *self.form)
        self.order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(keys, self.order, 1)

    def candidates(self, texts: list[str], edits: int) -> Iterator[tuple[int, int, int, int]]:
        """(text, word offset in it, item, word offset in it), each once, of
        the colliding windows that have all but ``edits`` words in common."""
        found, owner = symbols(texts)
        n = self.words
        if len(found) < n or not self.keys.shape[1]:
            return
        if self.known.dtype != np.uint8:
            self.known = bit_map(self.known)
        at = survivors(found, owner, n, edits, self.known)
        if not len(at):
            return
        keys = embed(found, at, n, *self.form)
        first = np.searchsorted(owner, np.arange(len(texts)))
        pairs = []
        for own, asked, order in zip(self.keys, keys, self.order):
            low = np.searchsorted(own, asked, "left")
            hit = np.flatnonzero(own[np.minimum(low, len(own) - 1)] == asked)
            low = low[hit]
            many = np.searchsorted(own, asked[hit], "right") - low
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pairs.append(np.repeat(hit, many).astype(np.int64) * len(own) + order[np.repeat(low, many) + inside])
        pairs = np.unique(np.concatenate(pairs))
        window = np.arange(n)
        for begin in range(0, len(pairs), 20_000):
            w, k = np.divmod(pairs[begin : begin + 20_000], self.keys.shape[1])
            a, b = found[at[w][:, None] + window], self.symbols[self.at[k][:, None] + window]
            common = (a[:, :, None] == b[:, None, :]).any(axis=2).sum(axis=1)
            for x, y in zip(w[common >= n - edits].tolist(), k[common >= n - edits].tolist()):
                text = int(owner[at[x]])
                yield text, int(at[x] - first[text]), int(self.owner[y]), int(self.offset[y])

    def matches(self, texts: list[str], edits: int) -> dict[tuple[int, int], tuple[int, int]]:
        """By (text, item): the least distance and the windows within edits."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        split: dict[int, list[str]] = {}
        for text, i, item, j in self.candidates(texts, edits):
            if text not in split:
                split[text] = WORD.findall(texts[text].lower())
            d = edit_distance(split[text][i : i + self.words], self.lists[item][1][j : j + self.words], edits)
            if d <= edits:
                old = best.get((text, item), (d, 0))
                best[text, item] = min(old[0], d), old[1] + 1
        return best


_FOUND = "item_id long, doc_id long, distance int, windows int"


def leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, edits: int = EDITS, words: int = WORDS) -> DataFrame:
    """(item_id, doc_id, distance, windows): the documents that hold a window
    of an item with at most ``edits`` words inserted, dropped or changed; the
    least number of edits, and the number of pairs of windows found."""
    chosen = items.select(items[item_key].cast("long").alias("i"), items[item_text].alias("t")).where("i is not null and t is not null").distinct()
    source = documents.select(documents[key].cast("long").alias("doc_id"), documents[text].alias("item_text")).where(F.length("item_text") > words)
    # A word has a letter and something after it.
    size = chosen.agg(F.sum(F.length("t"))).first()[0] or 0
    if size <= 2 * BLOCK_WINDOWS or chosen.select(F.sum(F.size(F.split("t", r"(?U)[\W_]+")))).first()[0] <= BLOCK_WINDOWS:
        packed = pickle.dumps(ItemBlock(sorted((r.i, r.t) for r in chosen.collect()), words))
        found = _against_block(source, packed, edits) if len(packed) <= BROADCAST_LIMIT else _against_table(source, chosen, edits, words)
    else:
        found = _against_table(source, chosen, edits, words)
    return found.groupBy("item_id", "doc_id").agg(F.min("distance").alias("distance"), F.max("windows").alias("windows"))


def _against_block(source: DataFrame, packed: bytes, edits: int) -> DataFrame:
    """The matches with the windows of one block of items."""
    sent = source.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemBlock = pickle.loads(sent.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                found = [(index.lists[item][0], ids[text], d, n) for (text, item), (d, n) in index.matches(texts, edits).items()]
                if found:
                    kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32()
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], ["item_id", "doc_id", "distance", "windows"])

    return source.mapInArrow(run, _FOUND)


def _keyed(source: DataFrame, name: str, words: int, edits: int, known) -> DataFrame:
    """(table, key, name, name_at, name_words): a row for each table and window;
    with a map ``known``, of the windows it doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if known is None else known.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                found, owner = symbols(texts)
                at = _starts(owner, words) if own is None else survivors(found, owner, words, edits, own)
                if not len(at):
                    continue
                first = np.searchsorted(owner, np.arange(len(texts)))
                lists = {int(x): WORD.findall(texts[x].lower()) for x in np.unique(owner[at])}
                for some in range(0, len(at), 2000):
                    a = at[some : some + 2000]
                    keys = embed(found, a, words)
                    place = (a - first[owner[a]]).tolist()
                    said = [" ".join(lists[x][p : p + words]) for x, p in zip(owner[a].tolist(), place)]
                    n = len(keys)
                    columns = [np.repeat(np.arange(n, dtype=np.int32), len(a)), keys.view(np.int64).ravel(), np.tile(np.array([ids[x] for x in owner[a]]), n), np.tile(np.array(place, np.int32), n)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(said * n, pa.string())], ["table", "key", name, f"{name}_at", f"{name}_words"])

    return source.mapInArrow(run, f"table int, key long, {name} long, {name}_at int, {name}_words string")


def _against_table(source: DataFrame, chosen: DataFrame, edits: int, words: int) -> DataFrame:
    """The matches with any number of items, by a join on the tables' keys."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = symbols(batch.column(1).to_pylist())
            if len(found) > 1:
                own = np.unique(_slots(found)[owner[:-1] == owner[1:]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own >> 5), pa.array(np.int64(1) << (own & 31))], ["word", "bits"])

    # At most 2 ** (MAP_BITS - 5) rows, however many items there are.
    rows = chosen.mapInArrow(slots, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).collect()
    known = np.zeros(1 << (MAP_BITS - 5), np.uint32)
    known[[r.word for r in rows]] = [r.bits for r in rows]
    sent = source.sparkSession.sparkContext.broadcast(known.astype("<u4").view(np.uint8))
    a, b = _keyed(source, "doc_id", words, edits, sent), _keyed(chosen, "item_id", words, edits, None)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.to_pydict()
            far = [edit_distance(x.split(" "), y.split(" "), edits) for x, y in zip(c["doc_id_words"], c["item_id_words"])]
            kept = pa.array([d <= edits for d in far])
            part = pa.RecordBatch.from_arrays([batch.column(n) for n in ("item_id", "doc_id", "item_id_at", "doc_id_at")] + [pa.array(far, pa.int32())], ["item_id", "doc_id", "item_id_at", "doc_id_at", "distance"])
            yield part.filter(kept)

    met = a.join(b, ["table", "key"]).drop("table", "key")
    near = written(met.mapInArrow(verified, "item_id long, doc_id long, item_id_at int, doc_id_at int, distance int")).distinct()
    return near.groupBy("item_id", "doc_id").agg(F.min("distance").alias("distance"), F.count("*").cast("int").alias("windows"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, questions = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_questions")
    return leaks(documents, "doc_id", "text", questions, "question_id", "reference_answer")


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with up to EDITS changed words in a window of WORDS."""
    return _leaks(spark, sf_dir).withColumnRenamed("item_id", "question_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks of WORDS consecutive words without any edit."""
    return _leaks(spark, sf_dir).where("distance = 0").select(F.col("item_id").alias("question_id"), "doc_id")


QUERIES = {"p9_near": p9_near, "p9_found": p9_found}
SQL = {
    "p9_found": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM documents),
q AS (SELECT question_id, list_filter(regexp_split_to_array(lower(reference_answer), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM eval_questions),
dg AS (SELECT doc_id, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
qg AS (SELECT question_id, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT question_id, w, unnest(range(1, len(w) - 11)) AS i FROM q))
SELECT DISTINCT question_id, doc_id FROM qg JOIN dg USING (g)
"""
}
