"""Chat logs from JSON and CSV files, term lists and labelled pairs."""

from __future__ import annotations

import csv
import io
import json
import re
import unicodedata
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MESSAGES, SCHEMA_VERSION, ContractError, ErrorCode, IngestSettings

REQUIRED = ("account_id", "message_id", "game_id", "timestamp_utc", "text")
_TIME = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?Z")


def file_format(path: str, wanted: str = "auto") -> str:
    if wanted != "auto":
        return wanted
    suffix = PurePosixPath(path).suffix.casefold()
    kinds = {".csv": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json"}
    if suffix not in kinds:
        raise ContractError("format")
    return kinds[suffix]


def map_fields(df: DataFrame, field_map: dict[str, str]) -> DataFrame:
    """The canonical fields, as strings, from the columns that field_map names."""
    missing = [k for k, v in field_map.items() if v not in df.columns]
    if missing:
        raise ContractError(missing[0])
    return df.select(*[F.col(v).cast("string").alias(k) for k, v in field_map.items()])


def system_flag(value: Column, true_values) -> Column:
    """true for the values given (trimmed, lower-cased), false for "", "false", "0" and null, else null."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*[t.strip().casefold() for t in true_values]), True).when(v.isin("", "false", "0") | v.isNull(), False)


def first_error(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that is broken, else null."""
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules], F.lit(None).cast("string"))


def _strict_json(text: str):
    """JSON without NaN and infinities; None where the text is none (a JSON null is no record anyhow)."""
    def refuse(_):
        raise ValueError

    try:
        return json.loads(text, parse_constant=refuse)
    except ValueError:
        return None


def _csv_rows(text: str) -> list[dict]:
    reader = csv.DictReader(io.StringIO(text, newline=""))
    try:
        named, rows = reader.fieldnames, list(reader)
    except csv.Error:
        raise ContractError("csv") from None
    if named is None:
        raise ContractError("csv_header")
    if any(None in r for r in rows):
        raise ContractError("csv_row")
    return rows


def _json_rows(text: str) -> list[dict]:
    """One document (a list, an object with a list of messages, or a message), else an object on each line; nothing at all is an error."""
    whole = _strict_json(text)
    if whole is None:
        rows = [_strict_json(line) for line in text.splitlines() if line.strip()]
        if rows and None not in rows and not all(isinstance(r, dict) for r in rows):
            raise ContractError("record")
        whole = rows or None
    elif isinstance(whole, dict):
        inner = whole.get("messages")
        whole = inner if isinstance(inner, list) else [whole]
    if not isinstance(whole, list) or not all(isinstance(r, dict) for r in whole):
        raise ContractError("json")
    return whole


def _records(data: bytes, kind: str) -> list[dict]:
    try:
        text = data.decode("utf-8", "strict")
    except UnicodeDecodeError:
        raise ContractError("path") from None
    return _csv_rows(text) if kind == "csv" else _json_rows(text)


def _flag(value, true_values) -> bool:
    if isinstance(value, bool):
        return value
    if value is None:
        return False
    if isinstance(value, str):
        v = value.strip().casefold()
        if v in {t.strip().casefold() for t in true_values}:
            return True
        if v in ("", "false", "0"):
            return False
    elif type(value) is int and value in (0, 1):
        return bool(value)
    raise ContractError("is_system")


def _message(row: dict, settings: IngestSettings) -> tuple:
    name = lambda k: settings.field_map.get(k, k)
    for k in REQUIRED:
        if not isinstance(row.get(name(k)), str) or (k != "text" and not row[name(k)]):
            raise ContractError(k)
    channel = row.get(name("channel_id"))
    if channel is not None and (not isinstance(channel, str) or not channel):
        raise ContractError("channel_id")
    if not _TIME.fullmatch(row[name("timestamp_utc")]):
        raise ContractError("timestamp_utc")
    flag = row.get(settings.system_flag_field or name("is_system"))
    if settings.system_flag_field is None and flag is not None and not isinstance(flag, bool):
        raise ContractError("is_system")
    return (*(row[name(k)] for k in ("account_id", "message_id", "game_id")), channel, row[name("timestamp_utc")], row[name("text")], _flag(flag, settings.system_true_values))


def ingest(spark: SparkSession, paths: list[str], settings: IngestSettings = IngestSettings()) -> DataFrame:
    """Messages of all files, rows numbered from 1 in each. An invalid file or row fails the query with its field's name and a code.

    Files are read whole by tasks, since JSON files fall back to lines only as a whole; contents never enter messages.
    """
    for p in paths:
        file_format(p, settings.format)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = [(*_message(x, settings), path, i) for i, x in enumerate(_records(data, file_format(path, settings.format)), 1)]
                cols = list(zip(*rows)) if rows else [()] * 9
                kinds = [pa.string()] * 6 + [pa.bool_(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=MESSAGES.names)

    return files.mapInArrow(run, MESSAGES)


def checked_duplicates(messages: DataFrame, dedupe: bool = True) -> DataFrame:
    """One message for each (game, message id). Repeats within a source, differing payloads, and any repeat without dedupe are errors."""
    payload = F.struct("account_id", "channel_id", "timestamp_utc", "text", "is_system")
    g = messages.groupBy("game_id", "message_id").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"), F.min(payload).alias("lo"), F.max(payload).alias("hi"))
    bad = (F.col("n") > F.col("sources")) | ~F.col("lo").eqNullSafe(F.col("hi")) | ((F.col("n") > 1) & F.lit(not dedupe))
    if not g.filter(bad).isEmpty():
        raise ContractError("message_id")
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("game_id", "message_id").orderBy("source_id", "source_row"))
    return messages.withColumn("rn", first).filter("rn = 1").drop("rn")


def term_list(text: str) -> tuple[list[str], str]:
    """(terms, language): a term on each line, # comments, one `# lang:` line at most."""
    language, terms = "und", set()
    seen = False
    for line in text.splitlines():
        s = line.strip()
        if s.startswith("#"):
            m = re.fullmatch(r"#\s*lang:\s*(\S+)", s)
            if m and seen:
                raise ContractError("lang")
            if m:
                language, seen = m[1], True
        elif s:
            terms.add(unicodedata.normalize("NFC", s))
    return sorted(terms), language


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, label, snapshot) with a < b, each once; blank lines, self pairs and conflicting labels are errors."""
    lines = spark.read.text(path)
    if not lines.filter(F.trim("value") == "").isEmpty():
        raise ContractError("pairs")
    p = lines.select(F.from_json("value", "schema_version string, account_id_a string, account_id_b string, label string, source_snapshot_id string").alias("j")).select("j.*")
    bad = F.col("schema_version").isNull() | (F.col("schema_version") != SCHEMA_VERSION) | F.col("account_id_a").isNull() | F.col("account_id_b").isNull() | (F.col("account_id_a") == F.col("account_id_b")) | ~F.coalesce(F.col("label").isin("same", "different"), F.lit(False))
    if not p.filter(bad).isEmpty():
        raise ContractError("pairs")
    out = p.select(F.least("account_id_a", "account_id_b").alias("a"), F.greatest("account_id_a", "account_id_b").alias("b"), "label", F.col("source_snapshot_id").alias("snapshot")).distinct()
    if not out.groupBy("a", "b").agg(F.count_distinct("label").alias("n")).filter("n > 1").isEmpty():
        raise ContractError("label")
    return out
