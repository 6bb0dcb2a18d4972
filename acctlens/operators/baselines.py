"""Eligible pairs, strata, stratified samples and baseline distributions of known-different pairs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ContractError, ErrorCode


def canonical_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs with a < b, each once; pairs that have conflicting labels). A pair of an account with itself is an error."""
    p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "label").distinct()
    conflicts = p.groupBy("a", "b").agg(F.count_distinct("label").alias("n")).filter("n > 1").select("a", "b")
    return p, conflicts


def eligible(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Known-different pairs of two ready accounts, with their stratum."""
    side = lambda s: profiles.filter("status = 'READY'").select(F.col("account_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("primary_game", "primary_channel", "active_months")])
    rows = pairs.filter("label = 'different'").dropDuplicates(["a", "b"]).join(side("a"), "a").join(side("b"), "b")
    return rows.select("a", "b", stratum().alias("stratum"))


def stratum():
    game = F.when(F.col("primary_game_a") == F.col("primary_game_b"), "same-game").otherwise("cross-game")
    channel = F.when(F.col("primary_channel_a") == F.col("primary_channel_b"), "same-channel").otherwise("other-channel")
    month = F.when(F.arrays_overlap("active_months_a", "active_months_b"), "same-month").otherwise("other-month")
    return F.concat_ws("|", game, channel, month)


def allocation(strata: DataFrame, maximum: int) -> DataFrame:
    """(stratum, n, take): shares of `maximum` by largest remainder, ties by name. strata: (stratum, n), a few rows."""
    everything = Window.partitionBy(F.lit(0))
    rows = strata.withColumn("all", F.sum("n").over(everything)).withColumn("total", F.least(F.lit(maximum).cast("long"), F.col("all")))
    rows = rows.withColumn("base", F.floor(F.col("total") * F.col("n") / F.col("all"))).withColumn("rest", F.pmod(F.col("total") * F.col("n"), F.col("all")))
    left = F.col("total") - F.sum("base").over(everything)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("can"), F.desc("rest"), "stratum"))
    rows = rows.withColumn("left", left).withColumn("can", F.col("base") < F.col("n")).withColumn("rank", rank)
    return rows.select("stratum", "n", (F.col("base") + F.when(F.col("can") & (F.col("rank") <= F.col("left")), 1).otherwise(0)).cast("long").alias("take"))


def sample(pairs: DataFrame, maximum: int, seed: int = 1729) -> DataFrame:
    """`allocation` pairs of each stratum, the first by a seeded hash."""
    takes = allocation(pairs.groupBy("stratum").agg(F.count("*").alias("n")), maximum)
    order = Window.partitionBy("stratum").orderBy(F.sha2(F.concat_ws("|", F.lit(seed), "a", "b"), 256))
    return pairs.withColumn("rn", F.row_number().over(order)).join(F.broadcast(takes), "stratum").filter("rn <= take").select("a", "b", "stratum")


def require_pairs(n: int, minimum: int = 1000) -> None:
    if n < minimum:
        raise ContractError("baseline", ErrorCode.MINIMUMS_NOT_MET)


def refresh_due(created: date, today: date, same_fingerprint: bool, known: int, new: int, days: int = 31, share: float = 0.10) -> bool:
    """A baseline is due after a change of fingerprint or month, after `days`, or when new pairs reach `share` of the known."""
    return not same_fingerprint or (created.year, created.month) != (today.year, today.month) or (today - created).days >= days or (known > 0 and new / known >= share)
