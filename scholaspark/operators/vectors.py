"""Vectors: a deterministic embedding, exact cosine search, clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, FloatType

from scholaspark.config import get_settings
from scholaspark.lineage import cut


def hashed_embedding(text: Column, dim: int | None = None) -> Column:
    """Signed feature hashing of the lower-case words of a text, of length 1.

    The default embedding: deterministic, without a model. Null, empty and
    wordless texts get the zero vector. Another embedding is any function of a
    column of texts that gives array<float>.
    """
    dim = dim or get_settings().embedding_dim
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    signs = F.transform(words, lambda w: F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    return _summed(slots, signs, F.lit(dim))


@F.pandas_udf(ArrayType(FloatType()))
def _summed(slots: pd.Series, signs: pd.Series, dim: pd.Series) -> pd.Series:
    found = []
    for i, s, n in zip(slots, signs, dim):
        v = np.bincount(i, s, n) if len(i) else np.zeros(n)
        size = np.linalg.norm(v)
        found.append((v / size if size else v).astype(np.float32))
    return pd.Series(found)


#: Digits of a score; beyond them the order of additions would decide ties.
DIGITS = 12


def search(vectors: DataFrame, queries: DataFrame, top_k: int = 5, id_column: str = "id", vector_column: str = "embedding", query_column: str = "query_id") -> DataFrame:
    """(query_id, id, score, rank): the exact top_k of each query by cosine.

    ``queries`` has (query_id, embedding). The queries go to every task in
    blocks of bounded size; each task multiplies its vectors with a block and
    keeps its own top_k per query, so what is shuffled is queries x tasks x
    top_k rows. Scores add up in double; ties go to the smaller id. Null
    vectors and vectors of another length are no candidates; a zero vector has
    score 0.
    """
    spark = vectors.sparkSession
    limit = get_settings().broadcast_bytes
    id_kind, query_kind = dict(vectors.dtypes)[id_column], dict(queries.dtypes)[query_column]
    named = vectors.select(vectors[id_column].alias("id"), vectors[vector_column].cast("array<float>").alias("v")).where("id is not null and v is not null")
    asked = queries.select(queries[query_column].alias("q"), queries["embedding"].cast("array<float>").alias("v")).where("q is not null and v is not null")
    schema = f"query_id {query_kind}, id {id_kind}, score double"
    kinds = to_arrow_type(asked.schema["q"].dataType), to_arrow_type(named.schema["id"].dataType), pa.float64()
    found = None
    block: list = []
    size = 0

    def flush() -> None:
        nonlocal found, block, size
        if block:
            sent = spark.sparkContext.broadcast([(q, np.asarray(v, np.float64)) for q, v in block])
            part = named.mapInArrow(_scorer(sent, top_k, kinds), schema)
            found = part if found is None else found.unionByName(part)
        block, size = [], 0

    # One block's worth of queries is at the driver at a time.
    for row in asked.toLocalIterator():
        block.append((row.q, row.v))
        size += 8 * len(row.v) + 64
        if size > limit:
            flush()
    flush()
    if found is None:
        found = spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top_k)


def _scorer(sent, top_k: int, kinds: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list] = {}
        for q, v in sent.value:
            by_dim.setdefault(len(v), []).append((q, v))
        matrices = {d: ([q for q, _ in x], np.array([v / (np.linalg.norm(v) or 1.0) for _, v in x])) for d, x in by_dim.items()}
        best: dict = {}
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), dtype=object)
            column = batch.column(1)
            sizes = np.diff(column.offsets.to_numpy())
            flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            starts = column.offsets.to_numpy()[:-1]
            for d, (names, matrix) in matrices.items():
                rows = np.flatnonzero(sizes == d)
                for first in range(0, len(rows), 4096):
                    part = rows[first : first + 4096]
                    v = flat[starts[part][:, None] + np.arange(d)]
                    norm = np.linalg.norm(v, axis=1)
                    scores = np.round((v / np.where(norm > 0, norm, 1.0)[:, None]) @ matrix.T, DIGITS)
                    keep = min(top_k, len(part))
                    for j, q in enumerate(names):
                        s = scores[:, j]
                        near = np.flatnonzero(s >= np.partition(s, -keep)[-keep])
                        old = best.get((d, q), [])
                        rows_q = old + [(-float(s[i]), ids[part[i]]) for i in near]
                        best[d, q] = sorted(rows_q)[:top_k]
        rows = [(q, i, -s) for (_, q), found in best.items() for s, i in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["query_id", "id", "score"])

    return run


class VectorIndex:
    """Vectors by the cell of the nearest of some centres, for searches that look
    only through the cells near a query.

    The centres are fitted on a sample of bounded size (``SAMPLE`` rows, by hash
    of the id), and so is how many cells a search must look through: as many as
    hold ``AIM`` of the true neighbours of ``TRIED`` vectors of the sample. Every
    vector is indexed. A cell of more than ``SLICE`` vectors is
    searched in slices, and the queries of a cell are a table like the vectors,
    so neither side passes through the driver. Null vectors and vectors of
    another length than most of the sample are not indexed.
    """

    SAMPLE = 20_000
    SLICE = 50_000
    TRIED = 300
    AIM = 0.97

    def __init__(self, cells: DataFrame, centres: np.ndarray, id_kind: str, probes: int):
        self.cells, self.centres, self.id_kind, self.probes = cells, centres, id_kind, probes

    @classmethod
    def build(cls, vectors: DataFrame, id_column: str = "id", vector_column: str = "embedding", cells: int | None = None, rounds: int = 10) -> VectorIndex:
        rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<float>").alias("v")).where("id is not null and v is not null")
        sample = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(cls.SAMPLE).select("v").collect()]
        sizes = [len(v) for v in sample]
        dim = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 1
        x = _unit(np.array([v for v in sample if len(v) == dim], np.float32).reshape(-1, dim))
        # About the square root of the vectors, so cells and centres cost alike.
        wanted = cells or max(1, min(len(x), int(rows.count() ** 0.5), get_settings().broadcast_bytes // (4 * dim)))
        centres = x[np.unique(np.linspace(0, max(len(x) - 1, 0), wanted).astype(int))] if len(x) else np.zeros((1, dim), np.float32)
        for _ in range(rounds if len(x) else 0):
            own = _nearest(x, centres, 1)[:, 0]
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            counts = np.bincount(own, minlength=len(centres))
            centres = _unit(np.where(counts[:, None] > 0, sums, centres))
        id_kind = dict(vectors.dtypes)[id_column]
        return cls(cut(_celled(rows.where(F.size("v") == dim), centres, 1, id_kind)), centres, id_kind, cls._probes(x, centres))

    @classmethod
    def _probes(cls, x: np.ndarray, centres: np.ndarray, near: int = 10) -> int:
        """In how many of a vector's nearest cells its neighbours lie."""
        if len(x) < 2:
            return 1
        own = _nearest(x, centres, 1)[:, 0]
        tried = x[np.unique(np.linspace(0, len(x) - 1, cls.TRIED).astype(int))]
        order = np.argsort(_nearest(tried, centres, len(centres)), axis=1)
        found = _nearest(tried, x, min(near, len(x)))
        places = np.take_along_axis(order, own[found], axis=1)
        return int(np.quantile(places, cls.AIM)) + 1

    def search(self, queries: DataFrame, top_k: int = 5, probes: int | None = None, query_column: str = "query_id") -> DataFrame:
        """(query_id, id, score, rank): the top_k of each query by cosine among
        the vectors of its nearest cells; ties go to the smaller id."""
        probes = probes or self.probes
        kind = dict(queries.dtypes)[query_column]
        asked = queries.select(F.col(query_column).alias("id"), F.col("embedding").cast("array<float>").alias("v")).where("id is not null and v is not null")
        asked = _celled(asked.where(F.size("v") == self.centres.shape[1]), self.centres, probes, kind).withColumnRenamed("id", "q")
        sizes = self.cells.groupBy("cell").agg(F.ceil(F.count("*") / self.SLICE).cast("int").alias("slices"))
        sizes = F.broadcast(sizes)  # A row for each centre.
        own = self.cells.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("id"), "slices").cast("int").alias("slice"), "id", "v")
        spread = asked.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "q", "v")

        def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            rows = []
            ids = left["id"].to_numpy()
            if len(left) and len(right):
                x = _unit(np.stack(left["v"].to_numpy()).astype(np.float64))
                for first in range(0, len(right), 256):
                    some = right.iloc[first : first + 256]
                    scores = np.round(_unit(np.stack(some["v"].to_numpy()).astype(np.float64)) @ x.T, DIGITS)
                    keep = min(top_k, len(left))
                    for q, s in zip(some["q"], scores):
                        near = np.flatnonzero(s >= np.partition(s, -keep)[-keep])
                        rows += [(q, i, -v) for v, i in sorted((-float(s[j]), ids[j]) for j in near)[:top_k]]
            return pd.DataFrame(rows, columns=["query_id", "id", "score"])

        found = own.groupBy("cell", "slice").cogroup(spread.groupBy("cell", "slice")).applyInPandas(best, f"query_id {kind}, id {self.id_kind}, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= top_k)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, the nearest first."""
    scores = x @ centres.T
    return np.argsort(-scores, axis=1, kind="stable")[:, :n]


def _celled(rows: DataFrame, centres: np.ndarray, n: int, kind: str) -> DataFrame:
    """(id, v, cell): each vector with its n nearest cells."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                x = np.array(part.column(1).to_pylist(), np.float32).reshape(part.num_rows, -1)
                own = _nearest(_unit(x), sent.value, n)
                at = np.repeat(np.arange(part.num_rows, dtype=np.int32), own.shape[1])
                taken = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(own.ravel().astype(np.int32))], ["id", "v", "cell"])

    return rows.select("id", "v").mapInArrow(run, f"id {kind}, v array<float>, cell int")


def cluster(vectors: DataFrame, k: int, id_column: str = "id", vector_column: str = "embedding", seed: int = 42) -> DataFrame:
    """(id, label): k-means clusters of the vectors; null vectors are left out."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col(vector_column).isNotNull()).select(F.col(id_column).alias("id"), array_to_vector(F.col(vector_column).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="label").fit(rows)
    return model.transform(rows).select("id", "label")
