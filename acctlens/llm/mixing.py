"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

A source's weight is its share of the tokens to the power alpha, normalised. alpha is bisected until the
weights have a target entropy or until no source is repeated more than allowed. Each source then gives its
weight's share of the token budget, epoch by epoch: its documents are dealt into blocks by a hash, every
epoch has its own order of the blocks and of the documents in a block, and the last epoch stops where the
source's quota is full.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, table

#: Leading bits of a block's place in the order by which blocks are grouped, so that no task orders all of them.
ORDER_BITS = 12
#: Documents of a block (on average), entropy aimed at (as a share of the largest possible), and most repetitions.
BLOCK_DOCS, ENTROPY, REPEATS = 1024, 0.95, 4.0


def tempered(tokens: dict, alpha: float) -> dict:
    total = sum(tokens.values())
    raw = {s: (n / total) ** alpha for s, n in tokens.items() if n > 0}
    norm = sum(raw.values())
    return {s: w / norm for s, w in raw.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisect_alpha(tokens: dict, budget: float, share: float | None = ENTROPY, repeats: float | None = REPEATS, rounds: int = 60) -> float:
    """The largest alpha in [0, 1] with an entropy of at least share * log(sources), but none at which a source repeats more than `repeats` times.

    Without a share, alpha is the least one that the limit allows. Entropy falls and the largest repetition falls as alpha grows, so each is bisected; where both can't be
    had, the repetition limit holds, and where even alpha = 1 breaks it (the budget is too large), alpha is 1.
    """
    tokens = {s: n for s, n in tokens.items() if n > 0}
    if len(tokens) < 2:
        return 1.0

    def border(low_side) -> float:
        """Largest alpha for which low_side holds, if it holds at 0 and then ceases."""
        low, high = 0.0, 1.0
        if low_side(1.0):
            return 1.0
        for _ in range(rounds):
            mid = (low + high) / 2
            low, high = (mid, high) if low_side(mid) else (low, mid)
        return low

    alpha = 0.0 if share is None else border(lambda a: entropy(tempered(tokens, a)) >= share * math.log(len(tokens)))
    if repeats is not None:
        most = lambda a: max(w * budget / tokens[s] for s, w in tempered(tokens, a).items())
        if most(alpha) > repeats:
            alpha = border(lambda a: most(a) > repeats) if most(1.0) <= repeats else 1.0
    return alpha


def mix_sources(docs: DataFrame, budget: float | None = None, share: float | None = ENTROPY, repeats: float | None = REPEATS, block_docs: int = BLOCK_DOCS, seed: int = 0, tokens=None) -> DataFrame:
    """A row for each time that a document is used: doc_id, source, epoch, block, tokens, weight, place.

    place is the token position within the source's quota, as a share of it: sorting by place interleaves
    the sources in their weights. tokens: a Column (default: words without ASCII white space); budget: tokens
    of the mixture (default: those of docs). A document is used while its source's quota isn't full when it
    begins, so a source exceeds its quota by less than a document. Documents without tokens take no place and
    are left out; a null source is a source by itself; a null doc_id is dealt like any other; repeated rows
    are documents by themselves, dealt to blocks apart from each other; an empty table gives an empty result;
    further columns are ignored. The driver holds a row for each source.
    """
    spark = docs.sparkSession
    count = tokens if tokens is not None else F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))
    rows = docs.select(F.col("doc_id").cast("long"), "source", F.coalesce(count.cast("long"), F.lit(0)).alias("tokens"))
    # Equal rows are numbered, so that one row repeated very often is not one block.
    rows = rows.filter("tokens > 0").groupBy("source", "doc_id", "tokens").agg(F.count("*").alias("copies"))
    rows = materialize(rows.select("source", "doc_id", "tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")), "mixing-rows")
    stats = rows.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("docs")).collect()
    by_source = {r.source: r.total for r in stats}
    whole = float(budget if budget is not None else sum(by_source.values()))
    weights = tempered(by_source, bisect_alpha(by_source, whole, share, repeats)) if by_source else {}
    plan = [(r.source, weights[r.source], weights[r.source] * whole, int(weights[r.source] * whole // r.total), r.total, max(1, -(-r.docs // block_docs))) for r in stats]
    plan = spark.createDataFrame(plan, "p_source string, weight double, quota double, epochs long, total long, blocks long")
    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tokens", "copy"), F.col("blocks")))
    used = dealt.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))))
    # Totals of blocks, then where each block begins in its source's epoch.
    in_block = used.groupBy("source", "epoch", "block").agg(F.sum("tokens").alias("block_tokens"))
    in_block = in_block.withColumn("turn", F.xxhash64(F.lit(seed), "epoch", "block")).withColumn("part", F.shiftright("turn", 64 - ORDER_BITS))
    in_part = in_block.groupBy("source", "epoch", "part").agg(F.sum("block_tokens").alias("part_tokens"))
    parts = in_part.withColumn("part_begin", F.sum("part_tokens").over(Window.partitionBy("source", "epoch").orderBy("part")) - F.col("part_tokens"))
    parts = parts.select(F.col("source").alias("p_source"), F.col("epoch").alias("p_epoch"), F.col("part").alias("p_part"), "part_begin")
    order = Window.partitionBy("source", "epoch", "part").orderBy("turn", "block")
    begins = in_block.withColumn("within", F.sum("block_tokens").over(order) - F.col("block_tokens"))
    begins = begins.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("epoch") == F.col("p_epoch")) & (F.col("part") == F.col("p_part")))
    begins = begins.select(F.col("source").alias("b_source"), F.col("epoch").alias("b_epoch"), F.col("block").alias("b_block"), (F.col("part_begin") + F.col("within")).alias("begin"))
    within = Window.partitionBy("source", "epoch", "block").orderBy(F.xxhash64(F.lit(seed), "epoch", "doc_id", "copy"), "doc_id", "tokens", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = used.withColumn("before", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    placed = placed.join(begins, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("epoch") == F.col("b_epoch")) & (F.col("block") == F.col("b_block")))
    at = F.col("epoch") * F.col("total") + F.col("begin") + F.col("before")
    return placed.withColumn("at", at).filter("at < quota").select("doc_id", "source", F.col("epoch").cast("int").alias("epoch"), "block", "tokens", "weight", (F.col("at") / F.col("quota")).alias("place"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
