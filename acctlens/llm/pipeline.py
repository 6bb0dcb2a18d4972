"""Stages of the corpus pipeline over `documents`, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
documents and no others, whatever further columns docs has; a column of documents that docs lacks is null.
Empty tables give empty results. Nulls, empty and very long texts, ties and repeated rows are treated as each
stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, mixing, quality, simhash
from ._common import materialize, table

#: Columns of documents with their types.
COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c).cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among docs, rejects go.

    Null and empty texts are judged by the classes' shares alone; repeated rows are judged each; a score equal to the threshold stays.
    """
    docs = _documents(docs)
    return quality.keep_accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; n_chars is counted anew. Rows with a null doc_id or text stay as they are; a text may become empty; see `dedup_lines`."""
    out = line_dedup.dedup_lines(_documents(docs))
    return _documents(out.withColumn("n_chars", F.length("text").cast("long")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, as one row even where its row is repeated (the one with the least text of those).

    Null and empty texts are near copies of each other. Rows with a null doc_id all stay.
    """
    docs = _documents(docs)
    found = simhash.near_duplicates(docs).filter("doc_id IS NOT NULL")
    ids = found.groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count("*").alias("n")).filter("n > 1 OR doc_id <> least")
    ids = materialize(ids.select(F.col("doc_id").alias("found_id"), (F.col("doc_id") != F.col("least")).alias("is_copy")), "pipeline-gone")
    once = docs.join(ids, F.col("found_id") == F.col("doc_id"), "left_anti")
    repeated = ids.filter("NOT is_copy")
    if repeated.isEmpty():
        return once
    row = F.min(F.struct("text", *[c for c in COLUMNS if c not in ("doc_id", "text")])).alias("r")
    kept = docs.join(repeated, F.col("found_id") == F.col("doc_id"), "left_semi").groupBy("doc_id").agg(row).select("doc_id", "r.*")
    return once.unionByName(kept)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage that holds a benchmark item go, with all rows of that doc_id; rows with a null doc_id or text stay."""
    return decontaminate.decontaminate(_documents(docs), table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document in the mixture; documents without words take no place in it; see `mix_sources`."""
    return mixing.mix_sources(_documents(docs))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
]
#: SQL can't express the classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
