"""Percentiles against baselines, and fusion of the engines' results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import running

ENGINES = ("stylometry", "semantic", "chronobiology")
WEIGHTS = (0.40, 0.35, 0.25)
EPSILON = 0.0005


def percentile(baseline: DataFrame, queries: DataFrame, value: str = "cosine") -> DataFrame:
    """queries with `percentile`: 100 times the share of baseline values at or below theirs.

    Values within 1e-9 outside [-1, 1] are clamped; others farther out get null (a result's status tells it).
    Equal values are first counted; the running count goes over ranges of distinct values, so neither side is
    sorted in one task.
    """
    x = F.col(value)
    inside = F.when(x.between(-1 - 1e-9, 1 + 1e-9), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))
    counts = baseline.groupBy(x.alias("v")).agg(F.count("*").alias("n"))
    asked = queries.select(inside.alias("v")).filter("v IS NOT NULL").distinct()
    both = counts.select("v", "n").unionByName(asked.select("v", F.lit(0).cast("long").alias("n"))).groupBy("v").agg(F.sum("n").alias("n"))
    run = running(both, "v", {"rank": "n"})
    total = baseline.agg(F.count("*").alias("total"))
    ranked = run.select(F.col("v").alias("q_v"), "rank").crossJoin(F.broadcast(total))
    out = queries.withColumn("q", inside).join(ranked, F.col("q") == F.col("q_v"), "left")
    return out.select(*queries.columns, F.try_divide(100 * F.col("rank"), F.col("total")).cast("double").alias("percentile"))


def fuse(results: DataFrame, weights=WEIGHTS, epsilon: float = EPSILON) -> DataFrame:
    """One row for each pair of results: columns <engine>_status, <engine>_percentile and <engine>_error are replaced by the fusion.

    Weights are shared out over the engines that are OK. Without any: INSUFFICIENT_DATA if all say so, else
    TIMEOUT if any does, else ERROR with the first engine's error.
    """
    ok = [F.col(f"{e}_status") == "OK" for e in ENGINES]
    w = [F.when(c, F.lit(x)).otherwise(0.0) for c, x in zip(ok, weights)]
    total = w[0] + w[1] + w[2]
    p = [F.coalesce(F.col(f"{e}_percentile"), F.lit(0.0)) for e in ENGINES]
    plain = F.greatest(F.lit(0.0), F.least(F.lit(100.0), sum((a * b for a, b in zip(w[1:], p[1:])), w[0] * p[0]) / total))
    log = [-F.ln(F.greatest(F.lit(epsilon), 1 - x / 100 + epsilon)) for x in p]
    evidence = sum((a * b for a, b in zip(w[1:], log[1:])), w[0] * log[0]) / total
    tail = 100 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 + epsilon - F.exp(-evidence)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 0.5 * plain + 0.5 * tail))
    any_ok = ok[0] | ok[1] | ok[2]
    status = [F.col(f"{e}_status") for e in ENGINES]
    all_short = (status[0] == "INSUFFICIENT_DATA") & (status[1] == "INSUFFICIENT_DATA") & (status[2] == "INSUFFICIENT_DATA")
    any_late = (status[0] == "TIMEOUT") | (status[1] == "TIMEOUT") | (status[2] == "TIMEOUT")
    named = lambda a, b, c, d: F.when(any_ok, a).when(all_short, b).when(any_late, c).otherwise(d)
    none = F.lit(None)
    active = F.concat_ws(",", *[F.when(c, F.lit(e)) for c, e in zip(ok, ENGINES)])
    keep = [c for c in results.columns if not any(c.startswith(f"{e}_") for e in ENGINES)]
    return results.select(
        *keep, named(F.lit("OK"), F.lit("INSUFFICIENT_DATA"), F.lit("TIMEOUT"), F.lit("ERROR")).alias("status"), F.when(any_ok, plain).alias("weighted_percentile"), F.when(any_ok, tail).alias("fisher_tail_score"),
        F.when(any_ok, score).alias("combined_score"), active.alias("active_engines"),
        named(none.cast("string"), F.lit("MINIMUMS_NOT_MET"), F.lit("ENGINE_TIMEOUT"), F.coalesce(*[F.col(f"{e}_error") for e in ENGINES])).alias("error"),
    )
