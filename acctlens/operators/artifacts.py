"""Fitted statistics and baselines as immutable, checked tables, with their fingerprints."""

from __future__ import annotations

from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, sha256_of
from ..schemas import SCHEMA_VERSION, ContractError, ErrorCode, PrepSettings

#: Versions that take part in fingerprints.
MESSAGE_ORDER, NORMALIZATION = "2.0", "1.0"


def prep_fingerprint(settings: PrepSettings, terms_digest: str, usernames_digest: str) -> str:
    """Identifies how messages were prepared. Retention is no part of it."""
    s = asdict(settings)
    return sha256_of({
        "normalization_spec_version": NORMALIZATION, "message_order_spec_version": MESSAGE_ORDER, "idle_gap_minutes": s["idle_gap_minutes"], "utc_hour_filter": s["hours"],
        "chunk_target_mode": s["chunk_mode"], "chunk_target_value": s["chunk_target"], "minimum_messages": s["minimum_messages"], "minimum_chars": s["minimum_chars"],
        "game_terms_sha256": terms_digest, "usernames_sha256": usernames_digest,
    })


def engine_fingerprint(engine: str, parts: dict[str, Any], prep: str) -> str:
    """Identifies an engine's settings and assets together with the preparation; no key may be missing or null."""
    if any(v is None for v in parts.values()):
        raise ContractError("configuration_fingerprint", ErrorCode.ARTIFACT_INVALID)
    return sha256_of({"engine": engine, **parts, "preprocessing_fingerprint": prep})


def table_digest(rows: DataFrame) -> str:
    """Digest of a table's rows whatever their order and partitions: the sum of their hashes, their number and their columns."""
    columns = sorted(rows.columns)
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    number = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    n, total = rows.agg(F.count("*"), F.sum(number)).first()
    return sha256_of({"columns": columns, "n": n, "sum": str(total or 0)})


def save(rows: DataFrame, folder: str, kind: str, **about) -> dict:
    """Writes a table and what it is about. A folder that holds one already is an error: artifacts never change."""
    spark = rows.sparkSession
    about = {"schema_version": SCHEMA_VERSION, "kind": kind, **about}
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        raise ContractError("output", ErrorCode.ARTIFACT_INVALID)
    rows.write.parquet(f"{folder}/rows")
    about["sha256"] = table_digest(spark.read.parquet(f"{folder}/rows"))
    spark.createDataFrame([(canonical_json(about).decode(),)], "value string").coalesce(1).write.text(f"{folder}/about")
    return about


def load(spark: SparkSession, folder: str, kind: str, **expected) -> tuple[DataFrame, dict]:
    """(table, what it is about), after the checks: kind and version, the table's digest, and what else is expected."""
    import json

    try:
        about = json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/about").collect()))
        rows = spark.read.parquet(f"{folder}/rows")
    except Exception as e:  # whatever is missing or unreadable, the artifact is no good
        raise ContractError("artifact", ErrorCode.ARTIFACT_INVALID) from e
    if about.get("schema_version") != SCHEMA_VERSION or about.get("kind") != kind or about.get("sha256") != table_digest(rows):
        raise ContractError("artifact", ErrorCode.ARTIFACT_INVALID)
    for k, v in expected.items():
        if about.get(k) != v:
            raise ContractError(k, ErrorCode.BASELINE_CONFIG_MISMATCH if kind == "baseline" else ErrorCode.ARTIFACT_INVALID)
    return rows, about


def snapshot_id(pairs: DataFrame) -> str:
    """Digest of the sorted distinct snapshot ids of labelled pairs (a few)."""
    return sha256_of(sorted(r[0] for r in pairs.select("snapshot_id").distinct().collect()))
