"""Access to the parquet tables of one input directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def settled(spark: SparkSession) -> SparkSession:
    """The session, with the one setting that right results need.

    Spark 4.1 lets a union pass on the partitioning of its sides. Together with
    a reused exchange this leaves out a shuffle that is needed, and rows come
    twice after a distinct or an aggregate over a union (the contexts of local
    search had each line up to four times). So unions here don't pass it on.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory ``sf_dir``."""
    return settled(spark).read.parquet(f"{sf_dir}/{name}.parquet")
