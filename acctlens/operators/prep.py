"""Filters, deduplication, sessions, chunks and profiles over messages."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import atomic_id, json_string, message_key
from ..schemas import PrepSettings

ORDER = ("us", "message_id", "game_id")


def accept(messages: DataFrame) -> DataFrame:
    """Messages that aren't system messages and have text; white space counts as text."""
    return messages.filter(~F.col("is_system") & (F.length("text") > 0))


def hour_of(us):
    return F.pmod(F.floor(us / 3_600_000_000), F.lit(24)).cast("int")


def hour_filter(messages: DataFrame, hours) -> DataFrame:
    return messages if hours is None else messages.filter(hour_of(F.col("us")).isin(list(hours)))


def dedupe(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one message for each key, keys with differing payloads). The earliest (source_id, source_row) stays.

    Payloads are compared whole, by their least and greatest.
    """
    payload = F.struct("account_id", "channel_id", "us", "text", "is_system")
    first = F.row_number().over(Window.partitionBy("game_id", "message_id").orderBy("source_id", "source_row"))
    kept = messages.withColumn("rn", first).filter("rn = 1").drop("rn")
    marked = messages.groupBy("game_id", "message_id").agg(F.min(payload).alias("lo"), F.max(payload).alias("hi"), F.count("*").alias("n"))
    return kept, marked.filter("NOT (lo <=> hi)").select("game_id", "message_id", "n")


def sessions(messages: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """messages with seq (order in the account) and session (from 0); a gap equal to the limit starts a new session."""
    order = Window.partitionBy("account_id").orderBy(*ORDER)
    gap = F.col("us") - F.lag("us").over(order)
    marked = messages.withColumn("seq", F.row_number().over(order)).withColumn("starts", F.when(gap >= gap_minutes * 60_000_000, 1).otherwise(0))
    return marked.withColumn("session", F.sum("starts").over(order)).drop("starts")


def chunks_by_messages(sessioned: DataFrame, target: int) -> DataFrame:
    """sessioned with chunk (from 0 in its session): `target` messages each."""
    order = Window.partitionBy("account_id", "session").orderBy("seq")
    return sessioned.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / target).cast("int"))


def chunks_by_chars(sessioned: DataFrame, target: int) -> DataFrame:
    """sessioned with chunk: greedy packing of whole messages into `target` characters, never across sessions.

    A chunk closes before a message that would exceed the target, and once it reaches it. Messages stream
    through in order with the state of one chunk, so a session may have any length.
    """
    schema = sessioned.withColumn("chunk", F.lit(0)).schema
    at = [sessioned.columns.index(c) for c in ("account_id", "session", "text")]

    def run(batches):
        now, chunk, filled = None, 0, 0
        for b in batches:
            account, session, text = (b.column(i) for i in at)
            out = []
            for key, n in zip(zip(account.to_pylist(), session.to_pylist()), pc.utf8_length(text).to_pylist()):
                if key != now:
                    now, chunk, filled = key, 0, 0
                n = n or 0
                if filled and filled + n > target:
                    chunk, filled = chunk + 1, 0
                out.append(chunk)
                filled += n
                if filled >= target:
                    chunk, filled = chunk + 1, 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, "chunk"])

    ordered = sessioned.repartition("account_id", "session").sortWithinPartitions("account_id", "session", "seq")
    return ordered.mapInArrow(run, schema)


def with_ids(chunked: DataFrame) -> DataFrame:
    """chunked messages with session_id and chunk_id: digests of the account, what they lie in, and their messages' keys in order."""
    keyed = chunked.withColumn("key", message_key(F.col("game_id"), F.col("message_id")))
    keys = lambda rows: F.transform(F.array_sort(rows), lambda x: x["key"])
    per_session = keyed.groupBy("account_id", "session").agg(F.collect_list(F.struct("seq", "key")).alias("k"))
    per_session = per_session.select("account_id", "session", atomic_id("session", F.col("account_id"), F.col("session").cast("string"), keys("k")).alias("session_id"))
    per_chunk = keyed.groupBy("account_id", "session", "chunk").agg(F.collect_list(F.struct("seq", "key")).alias("k")).join(per_session, ["account_id", "session"])
    per_chunk = per_chunk.select("account_id", "session", "chunk", "session_id", atomic_id("chunk", F.col("account_id"), json_string(F.col("session_id")), keys("k")).alias("chunk_id"))
    return chunked.join(per_chunk, ["account_id", "session", "chunk"])


def chunk_rows(chunked: DataFrame) -> DataFrame:
    """One row for each chunk: counts, bounds, ids and texts in order."""
    m = F.array_sort(F.collect_list(F.struct("seq", "message_id", "text", "us"))).alias("m")
    g = chunked.groupBy("account_id", "session", "chunk").agg(F.count("*").alias("n_messages"), F.sum(F.length("text")).alias("n_chars"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), m)
    return g.select("account_id", "session", "chunk", "n_messages", "n_chars", "start_us", "end_us", F.transform("m", lambda x: x["message_id"]).alias("message_ids"), F.transform("m", lambda x: x["text"]).alias("raw_text"))


def raw_stream(chunks: DataFrame) -> DataFrame:
    return chunks.select("account_id", "session", "chunk", "message_ids", "n_messages", "n_chars", "raw_text")


def normalized_stream(chunks: DataFrame, mask) -> DataFrame:
    """Masked texts joined by line ends, with their digest; raw texts are left out."""
    out = chunks.select("account_id", "session", "chunk", "n_messages", mask(F.col("raw_text")).alias("normalized_text"))
    return out.withColumn("normalized_sha256", F.sha2("normalized_text", 256))


def temporal_stream(chunked: DataFrame) -> DataFrame:
    """Times and lengths only."""
    m = F.array_sort(F.collect_list(F.struct("seq", "us", F.length("text").alias("n")))).alias("m")
    g = chunked.groupBy("account_id", "session", "chunk").agg(m)
    return g.select("account_id", "session", "chunk", F.transform("m", lambda x: x["us"]).alias("timestamps_us"), F.transform("m", lambda x: x["n"]).alias("char_counts"))


def histogram24(accepted: DataFrame) -> DataFrame:
    """(account_id, activity): 24 counts by UTC hour, zeros included, in one aggregation."""
    hour = hour_of(F.col("us"))
    return accepted.groupBy("account_id").agg(F.array(*[F.count(F.when(hour == h, 1)) for h in range(24)]).alias("activity"))


def most_common(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): the most frequent value, the least one on ties; nulls are ignored."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(name))


def profiles(messages: DataFrame, settings: PrepSettings = PrepSettings()) -> DataFrame:
    """One row for each account with an accepted message."""
    accepted = accept(messages)
    used = sessions(hour_filter(accepted, settings.hours), settings.idle_gap_minutes)
    counts = used.groupBy("account_id").agg(
        F.count("*").alias("n_messages"), F.sum(F.length("text")).alias("n_chars"), (F.max("session") + 1).alias("session_count"),
        F.array_sort(F.collect_set(F.date_format(F.timestamp_micros("us"), "yyyy-MM"))).alias("active_months"),
    )
    seen = accepted.groupBy("account_id").agg(F.array_sort(F.collect_set("game_id")).alias("games"))
    out = seen.join(most_common(accepted, "account_id", "game_id", "primary_game"), "account_id").join(most_common(accepted, "account_id", "channel_id", "primary_channel"), "account_id", "left")
    out = out.join(counts, "account_id", "left").fillna(0, ["n_messages", "n_chars", "session_count"])
    ready = (F.col("n_messages") >= settings.minimum_messages) & (F.col("n_chars") >= settings.minimum_chars)
    return out.withColumn("active_months", F.coalesce("active_months", F.array().cast("array<string>"))).withColumn("status", F.when(ready, "READY").otherwise("INSUFFICIENT_DATA"))


def omitted_accounts(messages: DataFrame) -> DataFrame:
    """Accounts without any accepted message."""
    return messages.select("account_id").distinct().join(accept(messages).select("account_id"), "account_id", "left_anti")
