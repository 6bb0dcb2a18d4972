"""Ranking metrics, thresholds, bootstrap intervals, components and splits."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import running
from ..schemas import ContractError, ErrorCode
from .graph import components


def by_score(rows: DataFrame) -> DataFrame:
    """(score, pos, neg): counts at each distinct score, the common input of the metrics."""
    return rows.groupBy("score").agg(F.count(F.when(F.col("is_same"), 1)).alias("pos"), F.count(F.when(~F.col("is_same"), 1)).alias("neg"))


def _running(scores: DataFrame) -> DataFrame:
    """scores with tp and fp: counts at or above each score."""
    return running(scores, "score", {"tp": "pos", "fp": "neg"}, descending=True)


def roc_auc(rows: DataFrame) -> DataFrame:
    """One row; null when a class is missing. Ties count half."""
    r = _running(by_score(rows))
    pairs = F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + 0.5 * F.col("neg") * F.col("pos"))
    return r.agg(F.try_divide(pairs, (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"))


def pr_auc(rows: DataFrame) -> DataFrame:
    """Step-wise area; within a tie the positives come first, so its precision rises one by one."""
    r = _running(by_score(rows))
    # Positive number i of a tie has precision (tp before + i) / (tp before + i + fp before).
    t0, f0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    tie = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("pos")), F.lit(0.0), lambda a, i: a + (t0 + i) / (t0 + i + f0))
    gain = F.when(F.col("pos") > 0, tie).otherwise(0.0)
    return r.agg(F.try_divide(F.sum(gain), F.sum("pos").cast("double")).alias("pr_auc"))


def precision_recall(rows: DataFrame, threshold: float) -> DataFrame:
    hit = F.col("score") >= threshold
    tp, fp = F.count(F.when(hit & F.col("is_same"), 1)), F.count(F.when(hit & ~F.col("is_same"), 1))
    pos = F.count(F.when(F.col("is_same"), 1))
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return rows.agg(zero(tp, tp + fp).alias("precision"), zero(tp, pos).alias("recall"))


def best_threshold(rows: DataFrame, min_precision: float = 0.80) -> DataFrame:
    """(threshold, met): the score with the best (recall, precision, -threshold) among those precise enough, else among all."""
    r = _running(by_score(rows))
    total = F.sum("pos").over(Window.partitionBy())
    r = r.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("recall", F.coalesce(F.try_divide(F.col("tp").cast("double"), total.cast("double")), F.lit(0.0)))
    key = F.struct((F.col("precision") >= min_precision).alias("ok"), "recall", "precision", (-F.col("score")).alias("low"))
    best = r.agg(F.max(key).alias("k"))
    return best.select(F.coalesce(-F.col("k.low"), F.lit(100.0)).alias("threshold"), F.coalesce(F.col("k.ok"), F.lit(False)).alias("met"))


def base_rate(rows: DataFrame) -> DataFrame:
    same = F.count(F.when(F.col("is_same"), 1))
    return rows.agg(F.coalesce(F.try_divide(same.cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("base_rate"), same.alias("support_same"), (F.count("*") - same).alias("support_different"))


def _auc(rows):
    order = sorted(rows)
    pos = sum(y for _, y in rows)
    if not pos or pos == len(rows):
        return None
    ranks, i = 0.0, 0
    while i < len(order):
        j = i
        while j < len(order) and order[j][0] == order[i][0]:
            j += 1
        ranks += (i + 1 + j) / 2 * sum(y for _, y in order[i:j])
        i = j
    return (ranks - pos * (pos + 1) / 2) / (pos * (len(rows) - pos))


def _rate(rows, threshold, which):
    tp = sum(1 for s, y in rows if y and s >= threshold)
    other = sum(1 for s, y in rows if (not y and s >= threshold if which == "precision" else y and s < threshold))
    return tp / (tp + other) if tp + other else 0.0


def draws(seed: int, size: int, n: int, chunk: int = 1 << 20):
    """n resamples of range(size), each as an array: what random.Random(seed).choice gives, drawn in chunks."""
    state = random.Random(seed).getstate()[1]
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint64), "pos": state[-1]}}
    shift = np.uint64(32 - size.bit_length())
    held, count = [], 0
    for _ in range(n):
        while count < size:
            r = words.random_raw(min(chunk, 2 * (size - count) + 16)) >> shift
            held.append(r[r < size].astype(np.int64))
            count += len(held[-1])
        drawn = np.concatenate(held)
        yield drawn[:size]
        held, count = [drawn[size:]], count - size


def _auc_of(neg: np.ndarray, pos: np.ndarray) -> float | None:
    """`_auc` of counts at each score, in rising order; sums of ranks are whole numbers, so it is the same to the last bit."""
    p, n = int(pos.sum()), int(neg.sum())
    if not p or not n:
        return None
    end = np.cumsum(neg + pos)
    ranks = int(((2 * end - (neg + pos) + 1) * pos).sum()) / 2
    return (ranks - p * (p + 1) / 2) / (p * n)


def bootstrap(rows: DataFrame, threshold: float, n: int = 1000, level: float = 0.95, seed: int = 1729) -> DataFrame:
    """(metric, low, high): percentile intervals. The rows are one evaluation's pairs (50,000 at most by contract), so each metric
    is one group of a grouped map; resamples follow Python's generator, over the pairs in the order of their accounts
    where these are given (columns a and b), else of their scores, so that results can be repeated elsewhere.
    A resample is counted at each distinct score and class, from which the metrics follow exactly."""
    keys = ["a", "b"] if {"a", "b"} <= set(rows.columns) else ["score", "is_same"]
    names = ("roc_auc", "precision", "recall")
    metrics = F.explode(F.array(*[F.lit(i) for i in range(len(names))])).alias("metric")
    spread = rows.select("score", "is_same", F.struct(*keys).alias("k"), metrics).select("score", "is_same", *[F.col(f"k.{c}").alias(f"k{i}") for i, c in enumerate(keys)], "metric")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        at = int(group.metric.iloc[0])
        group = group.sort_values(["k0", "k1"], kind="stable")
        scores, cell = np.unique(group.score.to_numpy(float), return_inverse=True)
        cell = (2 * cell + group.is_same.to_numpy(bool)).astype(np.int32)
        hit = scores >= threshold
        values = []
        for drawn in draws(seed + at, len(cell), n):
            count = np.bincount(cell[drawn], minlength=2 * len(scores))
            neg, pos = count[::2], count[1::2]
            tp = int(pos[hit].sum())
            if names[at] == "roc_auc":
                v = _auc_of(neg, pos)
            else:
                of = tp + int(neg[hit].sum() if names[at] == "precision" else pos[~hit].sum())
                v = tp / of if of else 0.0
            if v is not None:
                values.append(v)
        values.sort()
        a = (1 - level) / 2
        bound = lambda k: values[min(len(values) - 1, max(0, k))] if values else 0.0
        return pd.DataFrame([(names[at], bound(int(a * len(values))), bound(int((1 - a) * len(values)) - 1))], columns=["metric", "low", "high"])

    return spread.groupBy("metric").applyInPandas(one, "metric string, low double, high double")


def same_components(edges: DataFrame, nodes: DataFrame, folder: str) -> DataFrame:
    """(node, component) over same-edges (a, b), singletons included; see `graph.components`."""
    return components(edges, nodes, folder)


def split_components(components: DataFrame, fractions=(0.6, 0.2, 0.2), seed: int = 1729) -> DataFrame:
    """(node, part): whole components dealt to train, validation and test.

    The list of components is shuffled on the driver by Python's generator, which fixes the split; it has a
    row for each component of the labelled accounts.
    """
    spark = components.sparkSession
    groups = sorted(r.component for r in components.select("component").distinct().collect())
    random.Random(seed).shuffle(groups)
    part = lambda i: next(("train", "validation", "test")[k] for k, f in enumerate((fractions[0], fractions[0] + fractions[1], 2.0)) if (i + 0.5) / len(groups) < f)
    dealt = spark.createDataFrame([(g, part(i)) for i, g in enumerate(groups)], components.select("component").schema.add("part", "string"))
    return components.join(dealt, "component").select("node", "part")


def held_out(labelled: DataFrame, folder: str, fractions=(0.6, 0.2, 0.2), seed: int = 1729) -> tuple[DataFrame, DataFrame]:
    """((node, part) of every labelled account; labelled pairs (a, b, label) with their part). Accounts that belong together share a part; pairs across parts are left out."""
    nodes = labelled.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    dealt = split_components(same_components(labelled.filter("label = 'same'"), nodes, folder), fractions, seed)
    side = lambda s: dealt.select(F.col("node").alias(s), F.col("part").alias(f"part_{s}"))
    pairs = labelled.join(side("a"), "a").join(side("b"), "b").filter("part_a = part_b").select("a", "b", "label", F.col("part_a").alias("part"))
    return dealt, pairs


def engine_report(rows: DataFrame, engine: str, min_precision: float = 0.80, n_bootstrap: int = 1000, level: float = 0.95, seed: int = 1729) -> DataFrame:
    """One row of an engine's evaluation. rows: (a, b, part, is_same, score), the score null where the engine gave none.

    The threshold is chosen on the validation pairs; all else is measured on the test pairs.
    """
    spark = rows.sparkSession
    scored = rows.filter("score IS NOT NULL")
    threshold, met = best_threshold(scored.filter("part = 'validation'"), min_precision).first()
    test = scored.filter("part = 'test'").select("a", "b", "score", "is_same")
    excluded = rows.filter("part = 'test' AND score IS NULL").count()
    one = roc_auc(test).crossJoin(pr_auc(test)).crossJoin(precision_recall(test, threshold)).crossJoin(base_rate(test)).first().asDict()
    bounds = {r.metric: (r.low, r.high) for r in bootstrap(test, threshold, n_bootstrap, level, seed).collect()} if one["support_same"] + one["support_different"] else {}
    flat = {"engine": engine, "threshold": float(threshold), "met": bool(met), **one, "n_excluded": excluded}
    for m in ("roc_auc", "precision", "recall"):
        flat[f"{m}_low"], flat[f"{m}_high"] = bounds.get(m, (None, None))
    doubles = ("roc_auc", "pr_auc", "precision", "recall", "base_rate")
    schema = "engine string, threshold double, met boolean, " + ", ".join(f"{c} double" for c in doubles) + ", support_same long, support_different long, n_excluded long, " + ", ".join(f"{m}_{e} double" for m in ("roc_auc", "precision", "recall") for e in ("low", "high"))
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(flat[c] for c in names)], schema)


def evaluate(labelled: DataFrame, profiles: DataFrame, fit, folder: str, minimum_messages: int, minimum_chars: int, fractions=(0.6, 0.2, 0.2), min_precision: float = 0.80, n_bootstrap: int = 1000, level: float = 0.95, seed: int = 1729) -> DataFrame:
    """A row for each engine and one for their fusion: how well labelled pairs (a, b, label) are told apart on held-out accounts.

    fit(accounts) gives {engine: vectors of all accounts}, fitted on these accounts (account_id) alone, the ready
    ones of the training part. Baselines are the training part's known-different pairs of ready accounts; without any, an error.
    """
    from . import compare as cmp
    from .baselines import canonical_pairs

    labelled, conflicts = canonical_pairs(labelled)
    if not conflicts.isEmpty():
        raise ContractError("labels")
    dealt, pairs = held_out(labelled, folder, fractions, seed)
    ready = profiles.filter((F.col("status") == "READY") & (F.col("n_messages") >= minimum_messages) & (F.col("n_chars") >= minimum_chars)).select("account_id")
    training = dealt.filter("part = 'train'").select(F.col("node").alias("account_id")).join(ready, "account_id", "left_semi")
    different = pairs.filter("part = 'train' AND label = 'different'").join(ready.select(F.col("account_id").alias("a")), "a", "left_semi").join(ready.select(F.col("account_id").alias("b")), "b", "left_semi")
    if different.isEmpty():
        raise ContractError("training_baselines", ErrorCode.MINIMUMS_NOT_MET)
    engines = []
    for name, vectors in fit(training).items():
        base = cmp.baseline_of(different, name, vectors, "train", minimum_messages, minimum_chars)
        engines.append(cmp.Engine(name, vectors, "train", base, minimum_messages, minimum_chars))
    asked = pairs.filter("part <> 'train'")
    scored = cmp.compare(asked, profiles, engines).join(asked.select("a", "b", "part", (F.col("label") == "same").alias("is_same")), ["a", "b"])
    scored.write.mode("overwrite").parquet(f"{folder}/scored")
    scored = scored.sparkSession.read.schema(scored.schema).parquet(f"{folder}/scored")
    out = None
    for name, column in [*((e.name, f"{e.name}_percentile") for e in engines), ("combined", "combined_score")]:
        one = engine_report(scored.select("a", "b", "part", "is_same", F.col(column).alias("score")), name, min_precision, n_bootstrap, level, seed)
        out = one if out is None else out.union(one)
    return out
