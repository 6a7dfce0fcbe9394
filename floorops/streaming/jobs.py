"""Log jobs as Structured Streaming queries; each has a batch twin in ``operators``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorops.operators.logs import message_key


def stream_counts(stream: DataFrame, width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows by event-time window and tool; late rows beyond ``delay`` are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", delay).groupBy(w, "tool_name").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "tool_name", "n")


def stream_sessions(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Sessions by channel and user; a pause of 600 s or more ends one, hence the gap a microsecond shorter."""
    w = F.session_window("ts", "599999999 microseconds")
    return stream.withWatermark("ts", delay).groupBy("channel", "user", w).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("session_window")


def stream_messages(stream: DataFrame, delay: str = "1 day", receiver: str | None = None) -> DataFrame:
    """New messages by the MD5 of sender, receiver and first 80 characters, repeats within the watermark dropped."""
    return stream.withColumn("key", message_key(receiver)).withWatermark("time", delay).dropDuplicatesWithinWatermark(["key"])


def new_messages_to(stream: DataFrame, path: str, checkpoint: str, delay: str = "1 day", receiver: str | None = None):
    """Start a query that appends new messages to the folder of their day."""
    rows = stream_messages(stream, delay, receiver).withColumn("day", F.to_date("time"))
    return rows.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
