"""Queries of problem 2: mixed time labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timestamps import estimate_histories, estimate_zones, label_instants, with_clocks, with_estimated_clocks
from ..runtime import ship, table


def _labelled(spark: SparkSession, sf_dir: str, all_statuses: bool) -> DataFrame:
    ship(spark)
    messages = table(spark, sf_dir, "messages").select("row_id", "source_path", "chat_index", "message_index", "timestamp", "chat_date", "ingested_at")
    clocked = with_clocks(messages, table(spark, sf_dir, "transcript_files"))
    return label_instants(clocked, zone="clock", day_first="day_first", all_statuses=all_statuses)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that denote exactly one instant, with that instant."""
    return _labelled(spark, sf_dir, False).select("row_id", "field_name", "utc_second")


def p2_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many labels of each field are instants, and why the others are not."""
    return _labelled(spark, sf_dir, True).groupBy("field_name", "status").agg(F.count("*").alias("labels"))


def p2_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone that order and ingestion times alone suggest for each file, beside the stated one."""
    ship(spark)
    files = table(spark, sf_dir, "transcript_files")
    messages = table(spark, sf_dir, "messages").join(files.select("source_path", "date_order", "clock_zone"), "source_path", "left")
    guessed = estimate_zones(messages)
    return files.join(guessed, "source_path", "left").select(
        "source_path", F.coalesce("clock_zone", F.lit("UTC")).alias("stated_zone"), F.col("zone").alias("estimated_zone"), "violations", "gap_s"
    )


def p2_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p2_found with every clock's zone withheld and estimated from order and ingestion times."""
    ship(spark)
    messages = table(spark, sf_dir, "messages").select("row_id", "source_path", "chat_index", "message_index", "timestamp", "chat_date", "ingested_at")
    clocked = with_estimated_clocks(messages, table(spark, sf_dir, "transcript_files"))
    return label_instants(clocked, zone="clock", day_first="day_first", all_statuses=False).select("row_id", "field_name", "utc_second")


def p2_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stated zone the files that have labels of time, those whose estimated history is that zone alone, and labels with the right instant."""
    ship(spark)
    files = table(spark, sf_dir, "transcript_files").select("source_path", F.coalesce("clock_zone", F.lit("UTC")).alias("stated_zone"), "date_order")
    messages = table(spark, sf_dir, "messages").select("row_id", "source_path", "chat_index", "message_index", "timestamp", "chat_date", "ingested_at")
    zones = estimate_histories(messages.join(files, "source_path")).groupBy("source_path").agg(F.collect_set("zone").alias("zones"))
    of_files = files.join(zones, "source_path").groupBy("stated_zone").agg(F.count("*").alias("files"), F.count_if(F.col("zones") == F.array("stated_zone")).alias("right_files"))
    right = p2_found(spark, sf_dir).join(p2_estimated(spark, sf_dir).withColumnRenamed("utc_second", "guess"), ["row_id", "field_name"], "left")
    labels = right.join(messages.select("row_id", "source_path"), "row_id").join(files, "source_path").groupBy("stated_zone").agg(
        F.count("*").alias("labels"), F.count_if(F.col("utc_second") == F.col("guess")).alias("right_labels")
    )
    return labels.join(of_files, "stated_zone", "left").select("stated_zone", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("right_files", F.lit(0)).alias("right_files"), "labels", "right_labels")


QUERIES = {"p2_found": p2_found, "p2_status": p2_status, "p2_zones": p2_zones, "p2_estimated": p2_estimated, "p2_accuracy": p2_accuracy}
SQL: dict[str, str] = {}
