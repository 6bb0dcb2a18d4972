"""Sessions over a stream of messages: an event-time session window with a watermark.

A gap equal to the limit starts a new session, while Spark merges it; the window is a microsecond shorter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("account_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("text", T.StringType()), T.StructField("is_system", T.BooleanType())])


def stream_sessions(messages: DataFrame, gap_minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """(account_id, start, end, n_messages, n_chars), emitted once the watermark has passed a session."""
    accepted = messages.filter(~F.col("is_system") & (F.length("text") > 0)).withWatermark("ts", late)
    window = F.session_window("ts", f"{gap_minutes * 60 - 1} seconds 999999 microseconds").alias("w")
    g = accepted.groupBy("account_id", window).agg(F.count("*").alias("n_messages"), F.sum(F.length("text")).alias("n_chars"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return g.select("account_id", "start", "end", "n_messages", "n_chars")


def read_messages(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def run_once(spark: SparkSession, path: str, out: str, checkpoint: str, gap_minutes: int = 30) -> None:
    """Takes what has arrived at path, appends finished sessions to out and stops."""
    query = stream_sessions(read_messages(spark, path), gap_minutes).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
