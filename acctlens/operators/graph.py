"""Connected components of an edge list, by contraction to stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hang(edges: DataFrame, towards_all: bool) -> DataFrame:
    """Every node's neighbours are hung on the least of them (and the node itself). Minima are aggregated before the join, so a node with very many neighbours is no single group."""
    if towards_all:
        ways = edges.unionByName(edges.select(F.col("high").alias("low"), F.col("low").alias("high")))
        least = ways.groupBy("low").agg(F.least(F.min("high"), F.col("low")).alias("root"))
        moved = ways.filter("high > low").join(least, "low").select(F.col("root").alias("low"), "high")
    else:
        least = edges.groupBy("high").agg(F.min("low").alias("root"))
        moved = edges.join(least, "high").select(F.col("root").alias("low"), F.explode(F.array("low", "high")).alias("high"))
    return moved.filter("low <> high").distinct()


def components(edges: DataFrame, nodes: DataFrame, folder: str, most: int = 60) -> DataFrame:
    """(node, component) of all nodes (node) over edges (a, b), singletons included; component is the least node reached.

    Each round is written below `folder`, a shared one, which cuts the lineage; the round before is deleted.
    """
    spark = edges.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    old = None

    def write(df: DataFrame, k: int):
        df.write.mode("overwrite").parquet(f"{folder}/round-{k}")
        out = spark.read.schema(df.schema).parquet(f"{folder}/round-{k}")
        return out, tuple(out.agg(F.count("*"), F.bit_xor(F.xxhash64("low", "high")), F.bit_xor(F.xxhash64("high", "low"))).first())

    now, seen = write(edges.filter("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct(), 0)
    for k in range(1, most):
        now, mark = write(_hang(_hang(now, True), False), k)
        if old is not None:
            at = path(old)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        old = f"{folder}/round-{k - 1}"
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components: no end")
    up = now.groupBy("high").agg(F.min("low").alias("root"))
    return nodes.select("node").distinct().join(up, F.col("node") == F.col("high"), "left").select("node", F.coalesce("root", "node").alias("component"))
