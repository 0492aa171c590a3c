"""Problem 4: items that appear together, and how far above chance.

A blocked Gram matrix. The distinct (record, item) entries form a binary sparse
matrix, cut into blocks of records of about ``BLOCK_PAIRS`` products each. Within
a record, the items are one block, or, if they are more than ``PART_ITEMS``, as
many as needed (by hash of the item), and each pair of its item blocks goes to a
record block of its own. One task multiplies the transposed item blocks of a
record block with one another; the sparse products are summed over the record
blocks and held against the counts that independence would give.

Two exact bounds cut the work first. An item of a counted pair has at least
``min_together`` records. And since n(a,b) <= min(n(a), n(b)), a pair that
reaches ``lift`` has n(x) <= N / lift for both its items, so an item in more
records (a hot one) can't be in any and leaves before pairs are made.

So no task holds the square of a large basket, and only the entries of large
baskets are copied.

Defined results: null and empty arrays, null names and blank names are no
items; an item counts once in a record; a record of one item counts towards N.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholaspark.llm.common import table, written

MIN_TOGETHER = 5
LIFT = 8
#: Products that one record block is to have, and items of one item block.
BLOCK_PAIRS = 5_000_000
PART_ITEMS = 2_000


def folded(name: Column) -> Column:
    """Trimmed, in lower case, with every run of blanks as one."""
    return F.trim(F.regexp_replace(F.lower(name), r"(?U)\s+", " "))


def entries(extractions: DataFrame) -> DataFrame:
    """The distinct (record, item) of the extractions' names."""
    none = F.array().cast("array<string>")
    names = F.concat(*(F.coalesce(extractions[c][f], none) for c, f in (("entities", "name"), ("relations", "source"), ("relations", "target"))))
    each = extractions.select(extractions["chunk_id"].alias("record"), F.explode(F.array_distinct(F.transform(names, folded))).alias("item"))
    return each.where("item <> '' and record is not null").distinct()


def _codes(left: np.ndarray, right: np.ndarray, width: int, same: np.ndarray) -> Iterator[np.ndarray]:
    """Codes a * width + b, a < b, of the entries of the product of two sparse
    blocks.

    ``left`` and ``right`` are (unit, item) sorted by unit; ``same`` tells of
    each unit whether its sides are one block, whose pairs come twice. A bounded
    part of the products is held at a time.
    """
    counts = np.bincount(right[:, 0], minlength=len(same))
    first = np.concatenate([[0], np.cumsum(counts)])
    per = counts[left[:, 0]]
    ends = np.cumsum(per)
    begin = 0
    while begin < len(left):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + 2_000_000, "right")))
        n = per[begin:end]
        a, unit = np.repeat(left[begin:end, 1], n), np.repeat(left[begin:end, 0], n)
        offset = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        b = right[np.repeat(first[left[begin:end, 0]], n) + offset, 1]
        kept = (a < b) | ~same[unit]
        yield np.minimum(a, b)[kept] * width + np.maximum(a, b)[kept]
        begin = end


def block_product(pdf: pd.DataFrame) -> pd.DataFrame:
    """(a, b, n) with a < b: the products of one record block, summed."""
    unit = pdf.groupby(["record", "p", "q"], sort=False, dropna=False).ngroup().to_numpy()
    item, names = pd.factorize(pdf["item_no"], sort=True)
    order = np.argsort(unit, kind="stable")
    both, p, q, part = np.column_stack([unit, item])[order], *(pdf[c].to_numpy()[order] for c in ("p", "q", "part"))
    same = np.zeros(unit.max() + 1 if len(unit) else 0, bool)
    same[both[p == q, 0]] = True
    found: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for codes in _codes(both[part == p], both[part == q], len(names), same):
        u, n = np.unique(codes, return_counts=True)
        merged, inverse = np.unique(np.concatenate([found[0], u]), return_inverse=True)
        found = merged, np.bincount(inverse, np.concatenate([found[1], n]), len(merged)).astype(np.int64)
    width = max(len(names), 1)
    return pd.DataFrame({"a": names[found[0] // width], "b": names[found[0] % width], "n": found[1]})


def together(cells: DataFrame, min_together: int = MIN_TOGETHER, lift: int = LIFT, block_pairs: int = BLOCK_PAIRS, part_items: int = PART_ITEMS) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab, n_records): the pairs of items with at
    least ``min_together`` common records and at least ``lift`` times as many
    as chance would give. ``cells`` has the distinct (record, item)."""
    cells = written(cells)
    total = cells.select("record").distinct().count()
    items = written(
        cells.groupBy("item").agg(F.count("*").alias("n")).where((F.col("n") >= min_together) & (F.col("n") * lift <= total)).withColumn("item_no", F.monotonically_increasing_id())
    )
    kept = cells.join(items.select("item", "item_no"), "item").select("record", "item_no")
    sizes = kept.groupBy("record").agg(F.count("*").alias("k")).where("k > 1")
    kept = written(kept.join(sizes, "record").select("record", "item_no", F.ceil(F.col("k") / part_items).cast("int").alias("parts"), "k"))
    # Each entry of a record of k meets k others, half of them once.
    groups = max(1, int((kept.agg(F.sum("k")).first()[0] or 0) // (2 * block_pairs)) + 1)
    cut = kept.withColumn("part", F.pmod(F.xxhash64("item_no"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    units = cut.select("record", "item_no", "part", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
    products = units.groupBy(F.pmod(F.xxhash64("record", "p", "q"), F.lit(groups)).alias("block")).applyInPandas(block_product, "a long, b long, n long")
    sums = products.groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= min_together)
    left = items.select(F.col("item_no").alias("a"), F.col("item").alias("name_a"), F.col("n").alias("n_a"))
    right = items.select(F.col("item_no").alias("b"), F.col("item").alias("name_b"), F.col("n").alias("n_b"))
    found = sums.join(left, "a").join(right, "b").where(F.col("n_ab") * F.lit(total) >= F.lit(lift) * F.col("n_a") * F.col("n_b"))
    swap = F.col("name_a") > F.col("name_b")
    return found.select(
        F.least("name_a", "name_b").alias("item_a"),
        F.greatest("name_a", "name_b").alias("item_b"),
        F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
        F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
        "n_ab",
        F.lit(total).cast("long").alias("n_records"),
    )


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with their counts, lift and pointwise mutual information."""
    found = together(entries(table(spark, sf_dir, "extractions")))
    lift = F.col("n_ab") * F.col("n_records") / (F.col("n_a") * F.col("n_b"))
    return found.select("*", lift.alias("lift"), F.log(lift).alias("pmi"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return together(entries(table(spark, sf_dir, "extractions"))).select("item_a", "item_b")


QUERIES = {"p4_pairs": p4_pairs, "p4_found": p4_found}
_SQL = r"""
WITH names AS (
  SELECT chunk_id, unnest(list_transform(entities, lambda x: x.name)) AS name FROM extractions
  UNION ALL SELECT chunk_id, unnest(list_transform(relations, lambda x: x.source)) FROM extractions
  UNION ALL SELECT chunk_id, unnest(list_transform(relations, lambda x: x.target)) FROM extractions
), cells AS (
  SELECT DISTINCT chunk_id AS record, trim(regexp_replace(lower(name), '\s+', ' ', 'g')) AS item
  FROM names WHERE trim(regexp_replace(lower(name), '\s+', ' ', 'g')) <> ''
), total AS (SELECT count(DISTINCT record) AS n_records FROM cells),
counts AS (SELECT item, count(*) AS n FROM cells GROUP BY item),
pairs AS (
  SELECT x.item AS item_a, y.item AS item_b, count(*) AS n_ab
  FROM cells x JOIN cells y ON x.record = y.record AND x.item < y.item GROUP BY ALL HAVING count(*) >= 5
)
SELECT item_a, item_b, p.n AS n_a, q.n AS n_b, n_ab, n_records,
       CAST(n_ab * n_records AS DOUBLE) / (p.n * q.n) AS lift, ln(CAST(n_ab * n_records AS DOUBLE) / (p.n * q.n)) AS pmi
FROM pairs JOIN counts p ON p.item = item_a JOIN counts q ON q.item = item_b CROSS JOIN total
WHERE n_ab * n_records >= 8 * p.n * q.n
"""
SQL = {"p4_pairs": _SQL, "p4_found": f"SELECT item_a, item_b FROM ({_SQL})"}
