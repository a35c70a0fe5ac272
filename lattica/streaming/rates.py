"""Streams of result files: each key once, running totals, resumed from a checkpoint. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def once_each(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Rows whose keys haven't come within ``late``; state older than that is dropped."""
    return _timed(stream, time, late).dropDuplicatesWithinWatermark(keys)


def windowed_totals(stream: DataFrame, time: str, length: str, late: str, group: list[str], values: list[str]) -> DataFrame:
    """Counts and sums by window and group."""
    return _timed(stream, time, late).groupBy(F.window(time, length).alias("w"), *group).agg(F.count("*").alias("n"), *[F.sum(v).alias(v) for v in values]).select(F.col("w.start").alias("start"), *group, "n", *values)


def read_files(spark: SparkSession, path: str, schema, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what there is and ends; started again, it goes on where it stopped."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
