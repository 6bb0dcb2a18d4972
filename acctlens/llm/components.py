"""Connected components of a distributed edge list, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction: every node's neighbours are hung on its smallest neighbour (or itself).

    larger: all neighbours count for the minimum and those above the node move; else only those below
    it count, and it moves with them. Minima are pre-aggregated and joined back, so that a node with
    very many neighbours is never gathered in one task. The minima grow with the nodes, so the joins are
    shuffled whatever their size: a broadcast would take them through the driver.
    """
    if larger:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.filter("b > a").hint("merge").join(least, "a").select(F.col("b"), F.col("m").alias("a"))
        return moved.filter("a <> b").select("a", "b").distinct()
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.hint("merge").join(least, "b").select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a"))
    return moved.filter("a <> b").select("a", "b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b), a < b; component is its smallest reachable node.

    Each round writes its edges to the shared scratch folder, so the lineage stays short and a lost
    executor repeats one round at most. Stops when a round changes nothing: the edges are then stars.
    """
    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a").cast("decimal(38,0)"))).first())

    now = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")), "components")
    seen = mark(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        now = materialize(_stars(_stars(now, True), False), "components")
        before, seen = seen, mark(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components: no end after {most_rounds} rounds")
    # Roots are nodes too.
    both = F.explode(F.array(F.struct(F.col("b").alias("node"), F.col("a").alias("c")), F.struct(F.col("a").alias("node"), F.col("a").alias("c")))).alias("x")
    return now.select(both).select("x.*").groupBy("node").agg(F.min("c").alias("component"))
