"""Toxicity by non-negative positive-unlabelled learning.

A sparse linear classifier over hashed words is trained with numpy on confirmed toxic examples and
unlabelled text. With the class prior p, the risk of calling text non-toxic is estimated as
R_u(-) - p R_p(-); where that estimate of a batch is negative, which a true risk can't be, the step that
would push it further down is reversed instead (the non-negative estimator).

The classifier begins with all confirmed examples and some unlabelled texts, which also choose its words.
Then it is trained on with all unlabelled text: each text is reduced to the chosen words that it has, equal
ones are counted, and every step adds up the risk's slopes over all of these in a distributed pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, joined, materialize, mix, prefix_hash, slices, span_hash, spans, table

#: Hash buckets (as a power of two), lengths in bytes of the prefixes, and about how many confirmed and unlabelled rows training begins with at most.
BITS, PREFIXES, MAX_POSITIVE, BEGIN_UNLABELLED = 18, (4, 5), 4_000, 8_000
#: Steps over all unlabelled text, and their rate.
STEPS, RATE = 20, 0.05
THRESHOLD = 0.3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_buckets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, bucket) of each distinct bucket of each text, in order of the texts: of words (A-Z lower-cased) and of the prefixes of longer ones."""
    data, at = joined(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = spans(_WORD[data])
    c = prefix_hash(_LOWER[data])
    doc = np.searchsorted(at, start, "right") - 1
    parts = [(doc << BITS) | (span_hash(c, start, end) >> np.uint64(64 - BITS)).astype(np.int64)]
    for n in PREFIXES:
        longer = end - start > n
        h = mix(span_hash(c, start[longer], start[longer] + n) ^ np.uint64(n))
        parts.append((doc[longer] << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64))
    both = np.unique(np.concatenate(parts))
    return both >> BITS, both & ((1 << BITS) - 1)


def family(row: np.ndarray, sketch: int = 4) -> bytes:
    """What copies have in common: the `sketch` least hashed buckets of a row."""
    h = mix(row.astype(np.uint64) + np.uint64(1))
    return np.sort(np.partition(h, sketch)[:sketch]).tobytes() if len(h) > sketch else np.sort(h).tobytes()


def families(rows: list[np.ndarray]) -> list[np.ndarray]:
    """One row of each family of copies."""
    seen, out = set(), []
    for x in rows:
        key = family(x)
        if key not in seen:
            seen.add(key)
            out.append(x)
    return out


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, share: float = 0.05, **kw) -> tuple[np.ndarray, float]:
    """(weights by bucket, bias) of the linear classifier; each example is an array of distinct buckets.

    A classifier with an L1 penalty is trained to select buckets, those with at least `share` of the
    largest weight; a second one without the penalty is trained on these alone.
    """
    positive, unlabelled = families(positive), families(unlabelled)
    weights, bias = _descend(positive, unlabelled, prior, l1=1e-3 * max(1.0, (1000 / max(1, len(positive))) ** 0.5), **kw)
    if not weights.any():
        return weights, bias
    chosen = np.abs(weights) >= share * np.abs(weights).max()
    only = lambda rows: [x[chosen[x]] for x in rows]
    return _descend(only(positive), only(unlabelled), prior, l1=0.0, **kw)


def _descend(positive, unlabelled, prior: float, l1: float, epochs: int = 50, lr: float = 0.2, least_docs: int = 6, seed: int = 1) -> tuple[np.ndarray, float]:
    """Adam with a proximal L1 step on the non-negative risk, in batches of both kinds of rows."""
    weights = np.zeros(1 << BITS, np.float32)
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return weights, bias
    n_p, n_u = len(positive), len(unlabelled)
    cols = np.concatenate([*positive, *unlabelled])
    size = np.array([len(x) for x in [*positive, *unlabelled]])
    rows = np.repeat(np.arange(len(size)), size)
    seen = np.bincount(cols, minlength=1 << BITS)
    used = np.flatnonzero((seen >= least_docs) & (seen < 0.5 * len(size)))
    to = np.full(1 << BITS, -1)
    to[used] = np.arange(len(used))
    keep = to[cols] >= 0
    rows, cols = rows[keep], to[cols[keep]]
    first = np.searchsorted(rows, np.arange(len(size) + 1))
    rng = np.random.default_rng(seed)
    w, m, v, b, mb, vb, step = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used)), bias, 0.0, 0.0, 0
    batches = max(1, (n_p + n_u) // 512)
    for epoch in range(epochs):
        rate = lr * (1 - epoch / epochs) + 1e-3
        for p_rows, u_rows in zip(np.array_split(rng.permutation(n_p), batches), np.array_split(n_p + rng.permutation(n_u), batches)):
            if not len(p_rows) or not len(u_rows):
                continue
            some = np.concatenate([p_rows, u_rows])
            n = first[some + 1] - first[some]
            of = np.repeat(np.arange(len(some)), n)
            c = cols[np.arange(n.sum()) + np.repeat(first[some] - np.cumsum(n) + n, n)]
            z = b + np.bincount(of, w[c], len(some))
            s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            k = len(p_rows)
            # Logistic loss: softplus(-z) as toxic, softplus(z) as not; their slopes are s - 1 and s.
            negative = np.logaddexp(0, z[k:]).mean() - prior * np.logaddexp(0, z[:k]).mean()
            g = np.empty(len(some))
            if negative >= 0:
                g[:k] = prior * (s[:k] - 1) / k - prior * s[:k] / k
                g[k:] = s[k:] / (len(some) - k)
            else:
                g[:k] = prior * s[:k] / k
                g[k:] = -s[k:] / (len(some) - k)
            step += 1
            grad, gb = np.bincount(c, g[of], len(used)), g.sum()
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            mb += 0.1 * (gb - mb)
            vb += 0.001 * (gb * gb - vb)
            a = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            scale = a / (np.sqrt(v) + 1e-5)
            w -= scale * m
            w = np.sign(w) * np.maximum(0, np.abs(w) - scale * l1)
            b -= a * mb / (np.sqrt(vb) + 1e-5)
    weights[used] = w
    return weights, float(b)


def slopes(rows: list[np.ndarray], n: np.ndarray, w: np.ndarray, b: float) -> tuple[np.ndarray, float, float]:
    """Sums over rows of slots, each n times, of softplus(z), of its slope by weight, and of its slope by the bias."""
    size = np.array([len(x) for x in rows], np.int64)
    of, c = np.repeat(np.arange(len(rows)), size), np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
    z = b + np.bincount(of, w[c], len(rows))
    s = n / (1 + np.exp(-np.clip(z, -40, 40)))
    return np.bincount(c, s[of], len(w)), float(s.sum()), float((n * np.logaddexp(0, z)).sum())


def refine(positive: list[np.ndarray], patterns: DataFrame, w: np.ndarray, b: float, prior: float, steps: int = STEPS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """(w, b) after Adam steps on the non-negative risk over all of patterns (slots, n) and the positive rows of slots."""
    n_u = patterns.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not positive or not n_u or not len(w):
        return w, b
    ones = np.ones(len(positive))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        held = patterns.sparkSession.sparkContext.broadcast((w, b))

        def summed(batches, held=held):
            w, b = held.value
            total = np.zeros(len(w) + 2)
            for batch in batches:
                rows = [np.frombuffer(x, np.int32) for x in batch.column(0).to_pylist()]
                g, gb, loss = slopes(rows, batch.column(1).to_numpy(), w, b)
                total += np.concatenate((g, [gb, loss]))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "x"])

        u = np.zeros(len(w) + 2)
        for r in patterns.mapInArrow(summed, "slot long, x double").groupBy("slot").agg(F.sum("x").alias("x")).collect():  # a row for each weight
            u[r.slot] = r.x / n_u
        held.unpersist()
        g, gb, loss = slopes(positive, ones, w, b)
        p = prior * np.concatenate((g, [gb, loss])) / len(positive)
        count = np.bincount(np.concatenate([*positive, np.zeros(0, np.int32)]).astype(np.int64), minlength=len(w))
        toxic = p[:-1] - prior * np.concatenate((count, [len(positive)])) / len(positive)
        grad = toxic + u[:-1] - p[:-1] if u[-1] >= p[-1] else p[:-1] - u[:-1]
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        step = rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def scores(texts: list[bytes | None], weights: np.ndarray, bias: float) -> np.ndarray:
    doc, bucket = word_buckets(texts)
    z = bias + np.bincount(doc, weights[bucket], len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _rows(batch):
    """Distinct buckets of each text (column 1) of an Arrow batch, part by part, with the part."""
    for b in slices(batch):
        doc, bucket = word_buckets(b.column(1).to_pylist())
        cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
        yield b, [bucket[i:j] for i, j in zip(cut[:-1], cut[1:])]


def _gather(batches):
    for batch in batches:
        for b, rows in _rows(batch):
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array([x.astype(np.int32).tobytes() for x in rows], pa.binary())], names=["is_positive", "buckets"])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, max_positive: int = MAX_POSITIVE, begin_unlabelled: int = BEGIN_UNLABELLED) -> tuple[np.ndarray, float]:
    """Trains on about max_positive confirmed toxic documents at most and all others outside the held-out fold.

    The confirmed rows, and the about begin_unlabelled others that training begins with, are chosen by hashes;
    equal texts and copies count once, as do repeated rows; a doc_id with several texts stands for each of
    them. The class prior is the share of toxic rows among the labelled ones outside that fold. Null ids,
    null labels and labels without a document are ignored; of labels that contradict each other both count.
    """
    spark = docs.sparkSession
    usable = labels.filter(fold("doc_id", folds) != held_out).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long"), "toxic")
    share, n_toxic = usable.agg(F.avg((F.col("toxic") > 0).cast("double")), F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0))).first()
    prior = min(0.9, max(1e-3, share or 0.0))
    texts = docs.filter("doc_id IS NOT NULL").filter(fold("doc_id", folds) != held_out).select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    part = lambda n, most, *c: F.pmod(F.xxhash64(F.lit("toxicity"), *c), F.lit(1 << 20)) < int(min(1.0, most / max(1, n)) * (1 << 20))
    positive = materialize(usable.filter("toxic > 0").filter(part(n_toxic, max_positive, "doc_id")).select("doc_id").distinct(), "toxicity-rows")
    confirmed = texts.join(F.broadcast(positive), "doc_id").select("doc_id", "text", F.lit(True).alias("is_positive"))
    begin = texts.filter(part(texts.count(), begin_unlabelled, "doc_id", "text")).select("doc_id", "text", F.lit(False))
    rows = confirmed.union(begin).mapInArrow(_gather, "is_positive boolean, buckets binary").distinct()
    unique = [(r.is_positive, bytes(r.buckets)) for r in rows.toLocalIterator()]
    arrays = lambda kind: [np.frombuffer(x, np.int32).astype(np.int64) for k, x in sorted(unique) if k is kind]
    toxic = arrays(True)
    weights, bias = train(toxic, arrays(False), prior)
    chosen = np.flatnonzero(weights)
    if not len(chosen):
        return weights, bias
    slot = np.full(1 << BITS, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    held = spark.sparkContext.broadcast(slot)

    def reduced(batches):
        slot = held.value
        for batch in batches:
            for _, rows in _rows(batch):
                have = [slot[x] for x in rows]
                yield pa.RecordBatch.from_arrays([pa.array([family(x) for x in rows], pa.binary()), pa.array([x[x >= 0].tobytes() for x in have], pa.binary())], names=["family", "slots"])

    # One row of each family; then equal rows are counted.
    patterns = texts.mapInArrow(reduced, "family binary, slots binary").groupBy("family").agg(F.min("slots").alias("slots")).groupBy("slots").agg(F.count("*").alias("n"))
    patterns = materialize(patterns, "toxicity-patterns")
    w, bias = refine([x[x >= 0] for x in (slot[r] for r in families(toxic))], patterns, weights[chosen].astype(np.float64), bias, prior)
    weights[chosen] = w
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each input row.

    score uses the whole text only, so equal texts have equal scores; null and empty texts get the bias alone. A null doc_id has the fold of
    the empty text; repeated rows are scored each; an empty table gives an empty result; further columns
    are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        weights, bias = held.value
        for batch in batches:
            for b in slices(batch):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(scores(b.column(1).to_pylist(), weights, bias))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), (fold("doc_id", folds) == held_out).alias("held_out"))
    out = rows.mapInArrow(scored, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
