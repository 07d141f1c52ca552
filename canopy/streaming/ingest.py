"""Streaming ingest of sequences: repeats are dropped while a watermark keeps their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dedup_stream(stream: DataFrame, key: str, time: str, keep: str = "1 hour") -> DataFrame:
    """The first row of each key, for as long as the watermark keeps it."""
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def write_stream(stream: DataFrame, path: str, checkpoint: str, by: str | None = None):
    """Starts a query that appends to Parquet, with its progress kept at checkpoint; takes what there is and ends."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.partitionBy(by) if by else writer).trigger(availableNow=True).start(path)
