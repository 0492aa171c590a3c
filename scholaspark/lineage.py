"""Cutting the lineage of iterative plans, and taking away what that leaves."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholaspark.tables import settled

#: Tables of this process that are still there.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's
    checkpoint folder. Where both are unset and all runs on one machine, as in
    tests, a temporary folder is made for the session; a cluster must name one.
    """
    settled(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="scholaspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def step_path(spark: SparkSession) -> str:
    """A new path in the shared folder. What is written there goes when the
    process ends, or the ``scope`` around the call."""
    path = f"{shared_folder(spark)}/steps/{uuid.uuid4().hex}"
    _made.append(path)
    return path


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so the loss of an
    executor costs no more than its tasks."""
    path = step_path(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list, name: str, first: int = 0) -> DataFrame:
    """``df`` with the place of each row in the order of the keys: ranks within
    ranges of the sorted rows and the sizes of the ranges before, so no task
    holds all rows. The ranges are written once, so that both see the same ones.
    """
    ranged = cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").count()
    # One row per range.
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    placed = ranged.withColumn("_local", local).join(F.broadcast(before), "_part")
    return placed.withColumn(name, F.col("_local") + F.col("_before") + F.lit(first - 1)).drop("_part", "_local", "_before")


def _remove(paths: list[str]) -> None:
    jvm = SparkContext._jvm
    for path in paths if jvm is not None else ():
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


@contextmanager
def scope() -> Iterator[None]:
    """Takes away the tables made inside, whose results must have been used."""
    before = len(_made)
    try:
        yield
    finally:
        paths, _made[before:] = _made[before:], []
        _remove(paths)


def release(spark: SparkSession) -> None:
    """Takes away all tables of the session's folder."""
    _made.clear()
    _remove([f"{shared_folder(spark)}/steps"])


@atexit.register
def _at_exit() -> None:
    try:
        _remove(_made)
    except Exception:  # The JVM may be gone already.
        return
