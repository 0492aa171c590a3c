"""Streams: papers that arrive are chunked once; records are watched in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from scholaspark.operators.chunking import prepare_and_chunk
from scholaspark.operators.documents import documents_from_records


def papers(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the parquet files of paper records that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(stream: DataFrame, key: str = "doc_id", time: str = "ingested_at", late: str = "1 day") -> DataFrame:
    """The first load of each key: repeated loads within ``late`` are dropped,
    and the state of older keys is let go. Rows of null time are kept."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def chunk_stream(stream: DataFrame, target: str, checkpoint: str, **options) -> StreamingQuery:
    """Writes the chunks of arriving papers as parquet, each batch once: a batch
    that is run again after a failure overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        chunks = prepare_and_chunk(documents_from_records(batch), **options)
        chunks.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def record_windows(stream: DataFrame, time: str = "loaded_at", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, pipeline, n_rows, latency_s, fallbacks) of benchmark records."""
    from scholaspark.operators.benchmark import is_fallback, zero

    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, width), "pipeline")
        .agg(F.count("*").alias("n_rows"), F.avg(zero("latency_s")).alias("latency_s"), F.sum(is_fallback(F.col("answer")).cast("long")).alias("fallbacks"))
    )
