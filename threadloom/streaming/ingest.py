"""Structured Streaming ingest of message deliveries; an extension beyond the batch model.

A delivery is idempotent: rows sent again within the watermark are dropped by key, so a batch that is
replayed after a failure adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["participant", "source_path", "chat_index", "message_index"]


def deliveries(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """A stream of parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(stream: DataFrame, late: str) -> DataFrame:
    return stream.withColumn("ingested_at", F.col("ingested_at").cast("timestamp")).withWatermark("ingested_at", late)


def once(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """First delivery of each message within the watermark."""
    return _timed(stream, late).dropDuplicatesWithinWatermark(KEY)


def hourly(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Deliveries per participant and hour; late rows within the watermark still count."""
    return _timed(stream, late).groupBy(F.window("ingested_at", "1 hour").alias("hour"), "participant").agg(F.count("*").alias("rows"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Delivery sessions per participant, closed after a gap (mirrors gap sessions)."""
    return _timed(stream, late).groupBy(F.session_window("ingested_at", gap).alias("session"), "participant").agg(F.count("*").alias("rows"))


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A parquet sink that runs over what is there and stops."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
