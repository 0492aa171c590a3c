"""Problem 10: long spans that stand word for word in several records.

A log-structured fingerprint index. Each batch of records becomes an immutable
run: the winnowed hashes of its windows, bucketed and sorted by hash. A window
has ``WINDOW`` code points, and of any ``MIN_SPAN - WINDOW + 1`` neighbouring
windows the one of least hash is kept, so two texts that share a span of
``MIN_SPAN`` keep at least one window of it in common. A new run is merge-joined
with itself and with every older run (no shuffle, as all runs are bucketed
alike); runs of like size are then compacted into one. The runs, the shared
occurrences and a manifest lie in one folder, so a later session opens the index
and adds its batch. What is left are the occurrences of hashes found in two
records. Their neighbourhoods, cut from the texts, decide: the common text left
and right of the window is measured character by character, and ``MIN_SPAN``
must be reached.

Equal windows that overlap in a chain (a stretch that repeats itself) are one
occurrence with its first and last place. A hash with such a chain, or with more
than ``HOT`` occurrences (a notice in a third of all records, say), isn't
compared in pairs: its neighbourhoods are taken apart into their spans of exactly
``MIN_SPAN``, told apart by a digest of 128 bits, and only those found in two
records stay. They give the shared stretches without any pair; for the pairs, of
all spans with the same holders one is taken, and its holders meet in slices.

Defined results: null, empty and shorter texts are in no pair and have share 0;
repeated rows of an id count once; a span within one record only is not shared.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholaspark.lineage import step_path
from scholaspark.llm.common import BROADCAST_LIMIT, components, table, written

MIN_SPAN = 600
WINDOW = 400
#: Occurrences of one hash beyond which it is refined before pairs are made.
HOT = 64
#: Holders of one span that meet those of another slice in one task.
SLICE = 1000
#: Size ratio of neighbouring runs from which they are compacted.
RATIO = 4
_RUN = "hash BIGINT, item_id BIGINT, pos INT, last INT"
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(x))])) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def window_hashes(codes: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit polynomial hash of every window."""
    size = 1 << max(14, int(len(codes)).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        c = (codes.astype(np.uint64) + np.uint64(0x51)) * _MIX
        c ^= c >> np.uint64(29)
        c *= _MIX
        sums = np.concatenate([[np.uint64(0)], np.cumsum(c * up[: len(c)])])
        found = (sums[window:] - sums[:-window]) * down[: len(c) - window + 1]
        found ^= found >> np.uint64(31)
        found *= _MIX
    return found


def _sliding(values: np.ndarray, width: int, op, pad) -> np.ndarray:
    """op over each ``width`` neighbours, by block-wise running values."""
    n = len(values)
    full = np.full(-(-n // width) * width, pad, values.dtype)
    full[:n] = values
    blocks = full.reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - width + 1], ahead[width - 1 : n])


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the least of some ``width`` neighbours."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    least = _sliding(hashes, width, np.minimum, np.uint64(2**64 - 1))
    edge = np.zeros(width - 1, np.uint64)
    most = _sliding(np.concatenate([edge, least, edge]), width, np.maximum, np.uint64(0))
    return np.flatnonzero(hashes == most)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _chains(hashes: np.ndarray, at: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last) of the chains of equal hashes at most reach apart."""
    order = np.lexsort((at, hashes))
    h, at = hashes[order], at[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] - at[:-1] > reach)
    first = np.flatnonzero(new)
    return h[first], at[first], at[np.append(first[1:], len(h)) - 1] if len(h) else at


def fingerprints(text: str, min_span: int = MIN_SPAN, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last) of the windows that stand for a text; equal windows
    that overlap in a chain are one."""
    if len(text) < min_span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = window_hashes(_codes(text), window)
    at = winnow(hashes, min_span - window + 1)
    return _chains(hashes[at], at, window)


def fingerprint_rows(df: DataFrame, key: str, text: str, min_span: int, window: int) -> DataFrame:
    """(hash, item_id, pos, last) of every record."""
    source = df.select(df[key].cast("long").alias("item_id"), df[text].alias("item_text")).where(F.length("item_text") >= min_span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ids, hashes, at, last = [], [], [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if i is not None:
                        h, p, q = fingerprints(t, min_span, window)
                        ids.append(np.full(len(h), i, np.int64))
                        hashes.append(h.view(np.int64))
                        at.append(p.astype(np.int32))
                        last.append(q.astype(np.int32))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, ids, at, last)], ["hash", "item_id", "pos", "last"])

    return source.mapInArrow(run, "hash long, item_id long, pos int, last int")


class SpanIndex:
    """The runs of an index and the occurrences of shared hashes found so far.

    All lies in ``folder``; without one, in a folder that ``close`` removes but
    for the shared occurrences. The manifest is written after the data it names,
    so a session that breaks off leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, min_span: int = MIN_SPAN, window: int = WINDOW, buckets: int | None = None, folder: str | None = None):
        self.spark, self.min_span, self.window = spark, min_span, window
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.lasting = folder is not None
        self.folder = folder or step_path(spark)
        self.runs: list[tuple[str, int]] = []
        self.shared: list[str] = []
        self.version = 0
        self._cut: tuple[DataFrame, DataFrame] | None = None

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SpanIndex:
        """The index that an earlier session left in a folder."""
        found = spark.read.text(f"{folder}/manifest/*", wholetext=True).collect()
        state = max((json.loads(r.value) for r in found), key=lambda m: m["version"])
        index = cls(spark, state["min_span"], state["window"], state["buckets"], folder)
        index.runs, index.shared, index.version = [tuple(r) for r in state["runs"]], state["shared"], state["version"]
        for name, _ in index.runs:
            if not spark.catalog.tableExists(name):
                spark.sql(f"CREATE TABLE {name} ({_RUN}) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {index.buckets} BUCKETS LOCATION '{folder}/runs/{name}'")
        return index

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _save(self) -> None:
        self.version += 1
        state = {"version": self.version, "min_span": self.min_span, "window": self.window, "buckets": self.buckets, "runs": self.runs, "shared": self.shared}
        files, new = self._files(f"_manifest_{self.version}")
        out = files.create(new, True)
        out.write(json.dumps(state).encode())
        out.close()
        _, place = self._files(f"manifest/{self.version:09d}.json")
        files.mkdirs(place.getParent())
        files.rename(new, place)
        files.delete(self._files(f"manifest/{self.version - 1:09d}.json")[1], False)

    def _write(self, df: DataFrame) -> tuple[str, int]:
        name = f"span_run_{uuid.uuid4().hex}"
        df.repartition(self.buckets, "hash").write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.folder}/runs/{name}").saveAsTable(name)
        return name, self.spark.table(name).count()

    def add(self, batch: DataFrame, key: str, text: str) -> None:
        """Makes a run of the batch and joins it with itself and all others."""
        new = self._write(fingerprint_rows(batch, key, text, self.min_span, self.window))
        run = self.spark.table(new[0])
        ids = run.groupBy("hash").agg(F.min("item_id").alias("low"), F.max("item_id").alias("high"))
        both = run.join(ids.where("low < high").select("hash").hint("merge"), "hash", "left_semi")
        for name, _ in self.runs:
            old = self.spark.table(name)
            both = both.unionByName(run.join(old.select("hash").hint("merge"), "hash", "left_semi"))
            both = both.unionByName(old.join(run.select("hash").hint("merge"), "hash", "left_semi"))
        part = uuid.uuid4().hex
        both.write.parquet(f"{self.folder}/shared/{part}")
        self.shared.append(part)
        self.runs.append(new)
        self._cut = None
        stale = self.compact()
        self._save()
        for name in stale:
            self._drop(name)

    def compact(self) -> list[str]:
        """Merges the newest runs while the older is below RATIO times the
        newer; returns the runs that aren't needed any more."""
        stale = []
        while len(self.runs) > 1 and self.runs[-2][1] < RATIO * self.runs[-1][1]:
            (a, _), (b, _) = self.runs.pop(), self.runs.pop()
            self.runs.append(self._write(self.spark.table(a).unionByName(self.spark.table(b))))
            stale += [a, b]
        return stale

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        files, path = self._files(f"runs/{name}")
        files.delete(path, True)

    def close(self) -> None:
        """Takes the runs out of the session's catalog; a lasting index can be
        opened again, the runs of any other are removed."""
        for name, _ in self.runs:
            if self.lasting:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            else:
                self._drop(name)
        self.runs = self.runs if self.lasting else []

    def occurrences(self) -> DataFrame:
        """(hash, item_id, pos, last) of hashes that stand in two records."""
        return self.spark.read.schema(_RUN).parquet(*(f"{self.folder}/shared/{x}" for x in self.shared)).distinct()

    def _neighbourhoods(self, records: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
        """The matches of hashes compared in pairs, and the shared spans
        (x, y, item_id, begin, end) of the others."""
        if self._cut is None:
            reach, window = self.min_span - self.window, self.window
            where = written(self.occurrences())
            bytes_sent = where.count() * 48
            texts = records.select(records[key].cast("long").alias("item_id"), records[text].alias("item_text")).where(F.length("item_text") >= self.min_span)
            joined = texts.join(F.broadcast(where) if bytes_sent <= BROADCAST_LIMIT else where, "item_id")
            begin = F.greatest(F.col("pos") - reach, F.lit(0))
            part = F.col("item_text").substr(begin + 1, F.col("last") - begin + window + reach)
            slices = written(joined.select("hash", "item_id", "pos", "last", begin.alias("begin"), part.alias("part")).dropDuplicates(["hash", "item_id", "pos"]))
            sizes = slices.groupBy("hash").agg(F.count("*").alias("n"), F.max(F.col("last") - F.col("pos")).alias("chain"))
            plain = (F.col("n") <= HOT) & (F.col("chain") == 0)
            cool = slices.join(sizes.where(plain).select("hash"), "hash", "left_semi")
            hot = slices.join(sizes.where(~plain).select("hash"), "hash", "left_semi")
            spans = written(self._spans(hot))
            holders = spans.groupBy("x", "y").agg(F.min("item_id").alias("low"), F.max("item_id").alias("high"))
            kept = written(spans.join(holders.where("low < high").select("x", "y"), ["x", "y"], "left_semi"))
            self._cut = written(self._compared(cool).distinct()), kept
        return self._cut

    def matches(self, records: DataFrame, key: str, text: str) -> DataFrame:
        """(id_a, begin_a, end_a, id_b, begin_b, end_b), id_a < id_b: common
        stretches of at least min_span, proven on the texts; at least one for
        every pair that has any, but not all of a pair's."""
        cool, spans = self._neighbourhoods(records, key, text)
        return cool.unionByName(_holders_paired(spans, self.min_span)).distinct()

    def covered(self, records: DataFrame, key: str, text: str) -> DataFrame:
        """(item_id, begin, end): stretches that cover all that is shared."""
        cool, spans = self._neighbourhoods(records, key, text)
        sides = (cool.select(F.col(f"id_{s}").alias("item_id"), F.col(f"begin_{s}").alias("begin"), F.col(f"end_{s}").alias("end")) for s in "ab")
        return spans.select("item_id", "begin", "end").unionByName(next(sides)).unionByName(next(sides)).distinct()

    def _compared(self, slices: DataFrame) -> DataFrame:
        window, min_span = self.window, self.min_span
        a = slices.select("hash", *(F.col(c).alias(f"{c}_a") for c in ("item_id", "pos", "begin", "part")))
        b = slices.select("hash", *(F.col(c).alias(f"{c}_b") for c in ("item_id", "pos", "begin", "part")))
        pairs = a.join(b, "hash").where("item_id_a < item_id_b").drop("hash")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                c = batch.to_pydict()
                for ia, pa_, ba, ta, ib, pb, bb, tb in zip(*(c[f"{n}_{s}"] for s in "ab" for n in ("item_id", "pos", "begin", "part"))):
                    la, lb = pa_ - ba, pb - bb
                    if ta[la : la + window] != tb[lb : lb + window]:
                        continue
                    left = _common(ta[:la][::-1], tb[:lb][::-1])
                    right = _common(ta[la + window :], tb[lb + window :])
                    if left + window + right >= min_span:
                        rows.append((ia, pa_ - left, pa_ + window + right, ib, pb - left, pb + window + right))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32()) * 2)], ["id_a", "begin_a", "end_a", "id_b", "begin_b", "end_b"])

        return pairs.mapInArrow(run, "id_a long, begin_a int, end_a int, id_b long, begin_b int, end_b int")

    def _spans(self, slices: DataFrame) -> DataFrame:
        """(x, y, item_id, begin, end): the digests of the spans of min_span in
        the neighbourhoods, and the stretch that a chain of equal ones covers."""
        span = self.min_span

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c = batch.to_pydict()
                digests, ids, begins, ends = [], [], [], []
                for i, b, part in zip(c["item_id"], c["begin"], c["part"]):
                    if len(part) < span:
                        continue
                    _, first, last = _chains(window_hashes(_codes(part), span), np.arange(len(part) - span + 1), span)
                    digests += [hashlib.md5(part[f : f + span].encode("utf-8", "surrogatepass")).digest() for f in first.tolist()]
                    ids.append(np.full(len(first), i, np.int64))
                    begins.append((first + b).astype(np.int32))
                    ends.append((last + b + span).astype(np.int32))
                if ids:
                    xy = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in (xy[:, 0], xy[:, 1], *map(np.concatenate, (ids, begins, ends)))], ["x", "y", "item_id", "begin", "end"])

        return slices.select("item_id", "begin", "part").mapInArrow(run, "x long, y long, item_id long, begin int, end int")


def _holders_paired(spans: DataFrame, span: int) -> DataFrame:
    """The pairs of the holders of each span. Spans with the same holders give
    the same pairs, so one of them stands for all."""
    held = spans.groupBy("x", "y", "item_id").agg(F.min("begin").alias("begin"))
    sets = held.groupBy("x", "y").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(item_id))").alias("s"), F.expr("bit_xor(xxhash64(item_id, 7))").alias("t"))
    one = sets.groupBy("n", "s", "t").agg(F.min(F.struct("x", "y")).alias("k")).select("k.x", "k.y", F.ceil(F.col("n") / SLICE).cast("int").alias("slices"))
    own = written(held.join(one, ["x", "y"]).withColumn("own", F.pmod(F.xxhash64("item_id"), "slices").cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    a = own.select("x", "y", F.col("own").alias("slice_a"), other.alias("slice_b"), F.col("item_id").alias("id_a"), F.col("begin").alias("begin_a"))
    b = own.select("x", "y", other.alias("slice_a"), F.col("own").alias("slice_b"), F.col("item_id").alias("id_b"), F.col("begin").alias("begin_b"))
    met = a.join(b, ["x", "y", "slice_a", "slice_b"]).where("id_a < id_b")
    return met.select("id_a", "begin_a", (F.col("begin_a") + span).alias("end_a"), "id_b", "begin_b", (F.col("begin_b") + span).alias("end_b"))


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low + 1 < high:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def shares(covered: DataFrame, records: DataFrame, key: str, text: str) -> DataFrame:
    """(item_id, n_chars, shared_chars, share) of every record: the part of
    its text that also stands in another, overlaps counted once."""
    # A text in many pairs has few different stretches.
    edges = covered.groupBy("item_id", "begin").agg(F.max("end").alias("end"))
    before = Window.partitionBy("item_id").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(0))
    fresh = edges.select("item_id", F.greatest(F.col("end") - F.greatest(F.col("begin"), reach), F.lit(0)).alias("fresh"))
    shared = fresh.groupBy("item_id").agg(F.sum("fresh").cast("long").alias("shared_chars"))
    sizes = records.select(records[key].cast("long").alias("item_id"), F.coalesce(F.length(records[text]), F.lit(0)).cast("long").alias("n_chars")).distinct()
    n, s = F.col("n_chars"), F.coalesce(F.col("shared_chars"), F.lit(0)).cast("long")
    return sizes.join(shared, "item_id", "left").select("item_id", "n_chars", s.alias("shared_chars"), F.when(n > 0, s / n).otherwise(F.lit(0.0)).alias("share"))


def indexed(records: DataFrame, key: str, text: str, batches: list[DataFrame] | None = None, min_span: int = MIN_SPAN, window: int = WINDOW) -> SpanIndex:
    """An index of the records, made batch by batch; its runs are dropped."""
    index = SpanIndex(records.sparkSession, min_span, window)
    for batch in batches or [records]:
        index.add(batch, key, text)
    index.close()
    return index


def span_matches(records: DataFrame, key: str, text: str, batches: list[DataFrame] | None = None, min_span: int = MIN_SPAN, window: int = WINDOW) -> DataFrame:
    """The matches among the records, indexed batch by batch."""
    return indexed(records, key, text, batches, min_span, window).matches(records, key, text)


def _batches(documents: DataFrame) -> list[DataFrame]:
    """Two batches in order of arrival; rows without a time come last."""
    middle = documents.select(F.percentile_approx("ingested_at", 0.5, 1000)).first()[0]
    if middle is None:
        return [documents]
    late = (F.col("ingested_at") >= F.lit(middle)) | F.col("ingested_at").isNull()
    return [documents.where(F.col("ingested_at") < F.lit(middle)), documents.where(late)]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = span_matches(documents, "doc_id", "text", _batches(documents))
    return found.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b")).distinct()


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    covered = indexed(documents, "doc_id", "text", _batches(documents)).covered(documents, "doc_id", "text")
    return shares(covered, documents, "doc_id", "text").withColumnRenamed("item_id", "doc_id")


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that shares a span: the class of all it is linked with
    over any chain, named by its least id, and its number of links."""
    pairs = written(p10_found(spark, sf_dir))
    ends = pairs.select(F.explode(F.array("doc_id_a", "doc_id_b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("links"))
    return components(pairs, "doc_id_a", "doc_id_b").toDF("doc_id", "class_id").join(ends, "doc_id").select("doc_id", "class_id", "links")


QUERIES = {"p10_found": p10_found, "p10_shares": p10_shares, "p10_classes": p10_classes}
_GRAMS = "g AS (SELECT doc_id, i, md5(substr(text, i, 600)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 598)) AS i FROM documents WHERE length(text) >= 600))"
SQL = {
    "p10_classes": f"""
WITH RECURSIVE {_GRAMS}, held AS (SELECT DISTINCT doc_id, h FROM g),
pair AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.h = b.h AND a.doc_id <> b.doc_id),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM pair UNION SELECT reach.doc_id, pair.b FROM reach JOIN pair ON pair.a = reach.other)
SELECT doc_id, min(other) AS class_id, (SELECT count(*) FROM pair WHERE a = reach.doc_id) AS links FROM reach GROUP BY doc_id
""",
    "p10_found": f"WITH {_GRAMS} SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM (SELECT DISTINCT doc_id, h FROM g) a JOIN (SELECT DISTINCT doc_id, h FROM g) b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p10_shares": f"""
WITH {_GRAMS}, twice AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT DISTINCT doc_id, i FROM g WHERE h IN (SELECT h FROM twice)),
step AS (SELECT doc_id, least(600, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 600)) AS n FROM hit),
covered AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM step GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars, coalesce(n, 0) AS shared_chars,
       CASE WHEN coalesce(length(text), 0) > 0 THEN CAST(coalesce(n, 0) AS DOUBLE) / length(text) ELSE 0.0 END AS share
FROM documents LEFT JOIN covered USING (doc_id)
""",
}
