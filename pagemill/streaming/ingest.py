"""Continuous ingestion and usage windows with Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import shared_dir
from pagemill.sources.files import decoded, watched


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str) -> None:
    """All files that came since the last call, decoded to pages and added to the table ``target``; each file once."""
    q = decoded(watched(spark, folder)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def usage_windows(events: DataFrame, time: str, kind: str, value: str, late: str = "2 days", size: str = "1 day") -> DataFrame:
    """Extension: (window_start, kind, n, total) by event time; state older than ``late`` is dropped."""
    g = events.withWatermark(time, late).groupBy(F.window(time, size), F.col(kind))
    return g.agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), kind, "n", "total")


def run_to_table(stream: DataFrame, schema: str) -> DataFrame:
    """Run an append stream over what is there and read what it wrote."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/pagemill-stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")
