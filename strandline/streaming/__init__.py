"""Streams: cleaning and windowed counts of reads or events as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.plans import pipelines


def arriving(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def cleaned(reads: DataFrame, pipeline: str, **args) -> DataFrame:
    """A stream of reads through a cleaning pipeline: its steps keep no state, so they are the same as on a table."""
    return pipelines.clean(reads, pipeline, **args)


def windowed_counts(events: DataFrame, time: str, width: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Events in each window of ``width`` and group; state is dropped once ``late`` has passed."""
    out = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def first_of_each(events: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Events without those that repeat a key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def drained(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that has arrived so far, written as Parquet and remembered in ``checkpoint``; a later call goes on from there."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
