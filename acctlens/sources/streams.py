"""Stored streams: NDJSON chunks below a folder for each stream and account, written and read by Spark.

The three streams are kept apart, so that each engine reads the projection that it may see and no other.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prep import with_ids
from ..schemas import SCHEMA_VERSION, ContractError, ErrorCode

_COMMON = {"schema_version": "string", "chunk_id": "string", "account_id": "string", "session_id": "string", "n_messages": "long", "n_chars": "long"}
_BOUNDS = {"message_ids": "array<string>", "start_timestamp_utc": "string", "end_timestamp_utc": "string"}
#: The fields of each stream's chunks.
FIELDS = {
    "raw": _COMMON | _BOUNDS | {"raw_text": "array<string>"},
    "normalized": _COMMON | _BOUNDS | {"normalized_text": "string", "normalized_sha256": "string"},
    "temporal": _COMMON | {"timestamps_utc": "array<string>", "char_counts": "array<long>"},
}


def utc_text(us):
    """Microseconds as RFC 3339 text in UTC, with a fraction only where there is one."""
    whole = F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(us, F.lit(1_000_000))
    return F.concat(whole, F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0"))), F.lit("Z"))


def account_key(account):
    return F.sha2(account.cast("binary"), 256)


def stream_chunks(chunked: DataFrame, mask) -> dict[str, DataFrame]:
    """The chunks of each stream from chunked messages; mask: the masking of a text as a Column function."""
    m = with_ids(chunked).withColumn("masked", mask(F.col("text")))
    item = F.struct("seq", "message_id", "text", "masked", "us", F.length("text").cast("long").alias("n"))
    g = m.groupBy("account_id", "session", "chunk", "session_id", "chunk_id").agg(F.array_sort(F.collect_list(item)).alias("m"))
    each = lambda f: F.transform("m", f)
    g = g.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "chunk_id", "account_id", "session_id", F.size("m").cast("long").alias("n_messages"),
        F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_chars"), each(lambda x: x["message_id"]).alias("message_ids"),
        utc_text(F.get("m", F.lit(0))["us"]).alias("start_timestamp_utc"), utc_text(F.element_at("m", -1)["us"]).alias("end_timestamp_utc"), each(lambda x: x["text"]).alias("raw_text"),
        F.array_join(each(lambda x: x["masked"]), "\n").alias("normalized_text"), each(lambda x: utc_text(x["us"])).alias("timestamps_utc"), each(lambda x: x["n"]).alias("char_counts"), "session", "chunk",
    ).withColumn("normalized_sha256", F.sha2(F.col("normalized_text").cast("binary"), 256))
    return {kind: g.select(*fields, "session", "chunk") for kind, fields in FIELDS.items()}


def write_streams(streams: dict[str, DataFrame], folder: str) -> None:
    """folder/<stream>/account_key=<SHA-256 of the account>/: a line of JSON with sorted keys for each chunk, in order."""
    for kind, chunks in streams.items():
        line = F.to_json(F.struct(*sorted(FIELDS[kind])), {"ignoreNullFields": "false"})
        rows = chunks.select(account_key(F.col("account_id")).alias("account_key"), "session", "chunk", line.alias("value"))
        ordered = rows.repartition("account_key").sortWithinPartitions("account_key", "session", "chunk").select("account_key", "value")
        ordered.write.mode("overwrite").partitionBy("account_key").text(f"{folder}/{kind}")


def read_stream(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Chunks of a stored stream with `error`: null, or the first field that breaks the contract. Nothing of a text shows in errors."""
    fields = FIELDS[kind]
    schema = ", ".join(f"{k} {t}" for k, t in fields.items())
    lines = spark.read.text(f"{folder}/{kind}").select("value", F.col("account_key").cast("string").alias("account_key"))
    names = F.json_object_keys("value")
    rows = lines.select("account_key", names.alias("names"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("c")).select("account_key", "names", "c.*")
    rules = [("json", F.col("names").isNull() | (F.array_sort("names") != F.array(*[F.lit(k) for k in sorted(fields)])))]
    rules += [("schema_version", ~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)))]
    rules += [(k, F.coalesce(F.length(k), F.lit(0)) == 0) for k in ("chunk_id", "account_id", "session_id")]
    rules += [("account_id", account_key(F.col("account_id")) != F.col("account_key"))]
    size = {"raw": F.size("raw_text"), "normalized": F.size("message_ids"), "temporal": F.size("timestamps_utc")}[kind]
    rules += [("n_messages", F.coalesce((F.col("n_messages") < 1) | (F.col("n_messages") != size), F.lit(True)))]
    total = {"raw": F.aggregate("raw_text", F.lit(0).cast("long"), lambda s, x: s + F.length(x)), "temporal": F.aggregate("char_counts", F.lit(0).cast("long"), lambda s, x: s + x)}.get(kind)
    if total is not None:
        rules += [("n_chars", F.coalesce(F.col("n_chars") != total, F.lit(True)))]
    if kind == "normalized":
        rules += [("normalized_sha256", ~F.sha2(F.col("normalized_text").cast("binary"), 256).eqNullSafe(F.col("normalized_sha256")))]
    if kind == "temporal":
        rules += [("char_counts", F.size("char_counts") != F.size("timestamps_utc")), ("timestamps_utc", F.coalesce(F.array_sort("timestamps_utc") != F.col("timestamps_utc"), F.lit(True)))]
    return rows.select(*fields, F.coalesce(*[F.when(bad, name) for name, bad in rules]).alias("error"))


def checked_stream(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Chunks of a stored stream; an error where any of them breaks the contract."""
    rows = read_stream(spark, folder, kind)
    bad = rows.filter("error IS NOT NULL").agg(F.min("error")).first()[0]
    if bad:
        raise ContractError(bad, ErrorCode.ARTIFACT_INVALID)
    return rows.drop("error")


def stream_totals(chunks: DataFrame) -> DataFrame:
    """(account_id, n_messages, n_chars) of a stream, to be compared with profiles."""
    return chunks.groupBy("account_id").agg(F.sum("n_messages").alias("n_messages"), F.sum("n_chars").alias("n_chars"))


def expire(spark: SparkSession, folder: str, days: int, now: float | None = None) -> int:
    """Deletes the streams of accounts that were written more than `days` days ago; 0 days keep all. Returns how many folders went."""
    if not days:
        return 0
    cutoff, gone = ((time.time() if now is None else now) - days * 86_400) * 1000, 0
    for kind in FIELDS:
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}")
        fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if fs.exists(root):
            for status in fs.listStatus(root):
                if status.isDirectory() and status.getModificationTime() < cutoff:
                    gone += bool(fs.delete(status.getPath(), True))
    return gone
