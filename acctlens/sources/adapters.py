"""Adapter views that read test tables as chat messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def micros(ts):
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return (seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")).cast("long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as messages: user as account, event type as game, props.k as channel, errors as system messages."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("user_id").cast("string").alias("account_id"), F.col("event_id").cast("string").alias("message_id"), F.col("event_type").alias("game_id"),
        F.get_json_object("props", "$.k").alias("channel_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), micros(F.col("ts").cast("timestamp_ntz")).alias("us"),
        F.concat_ws(" ", "event_type", "props").alias("text"), (F.col("event_type") == "error").alias("is_system"),
        F.lit("events").alias("source_id"), (F.col("event_id") + 1).alias("source_row"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as messages: source as account, language as game."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        F.col("source").alias("account_id"), F.col("doc_id").cast("string").alias("message_id"), F.col("lang").alias("game_id"), F.lit(None).cast("string").alias("channel_id"),
        (F.lit(1704067200_000_000) + F.col("doc_id") * 420_000_000).alias("us"), "text", F.lit(False).alias("is_system"),
        F.lit("documents").alias("source_id"), (F.col("doc_id") + 1).alias("source_row"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages: conversation and role as account."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), "role").alias("account_id"), F.col("turn").cast("string").alias("message_id"), F.col("conv_id").cast("string").alias("game_id"),
        F.lit(None).cast("string").alias("channel_id"), (F.lit(1704067200_000_000) + F.col("conv_id") * 3_600_000_000 + F.col("turn") * 60_000_000).alias("us"),
        "text", (F.col("role") == "system").alias("is_system"), F.lit("conversations").alias("source_id"), F.lit(1).cast("long").alias("source_row"),
    )
