"""Streams of pages: stateless extraction and idempotent appends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.sources.sinks import cache_put


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_requests(stream: DataFrame, respond: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each request row answered once: ``respond`` is applied to every batch and its rows are appended."""

    def batch(df: DataFrame, n: int) -> None:
        respond(df).write.mode("append").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cache_stream(stream: DataFrame, cache: str, digest: str, private: str, checkpoint: str) -> StreamingQuery:
    """Content-addressed results from a stream; a repeated batch or digest adds nothing."""

    def batch(df: DataFrame, n: int) -> None:
        cache_put(df, cache, digest, private)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per window and kind, late rows dropped behind the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
