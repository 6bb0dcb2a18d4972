"""Quality classifier with supervised subword embeddings.

Every word, pair of equal neighbouring words and character n-gram (as written, case included) is hashed to
a learned vector; a document is the mean of its vectors, and a softmax layer over that mean gives the
classes. Vectors and layer are trained together by stochastic gradient descent in numpy. For scoring, the
layer is applied to each vector beforehand: the mean of the results is the result of the mean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, joined, materialize, prefix_hash, slices, span_hash, spans, table

#: Hash buckets (as a power of two), dimensions, n-gram lengths in bytes, and the most labelled rows that training gathers.
BITS, DIM, NGRAMS, MAX_LABELLED = 17, 12, (3, 4), 2_500
THRESHOLD = 0.3
#: Bytes of text handled at once: a feature takes some 50 bytes for a moment, and there are about three for each byte.
SLICE = 1 << 18
_REPEAT = np.uint64(0x5DEECE66D0F1E2D3)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def features(texts: list[bytes | None]):
    """Yields (text's index, bucket) of every feature, kind by kind; the indexes ascend within a kind."""
    data, at = joined(texts)
    if not len(data):
        return
    c = prefix_hash(data)
    shift = np.uint64(64 - BITS)
    start, end = spans(~_SPACE[data])
    h = span_hash(c, start, end)
    doc = np.searchsorted(at, start, "right") - 1
    yield doc, (h >> shift).astype(np.int32)
    again = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    yield doc[again], np.full(len(again), int(_REPEAT >> shift), np.int32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(at))
    for n in NGRAMS:
        i = np.arange(max(0, len(data) - n + 1))
        i = i[owner[i] == owner[i + n - 1]]
        yield owner[i], (span_hash(c, i, i + n) >> shift).astype(np.int32)


def counted(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their counts."""
    parts = [(d.astype(np.int64) << BITS) | b for d, b in features(texts)]
    both, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    cut = np.searchsorted(both, np.arange(len(texts) + 1) << BITS)
    return [((both[i:j] & ((1 << BITS) - 1)).astype(np.int32), n[i:j].astype(np.int32)) for i, j in zip(cut[:-1], cut[1:])]


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, lr: float = 0.6, seed: int = 1) -> tuple[np.ndarray, float]:
    """(log-odds by bucket, bias) after training; an example is (buckets, counts, class)."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    if examples:
        share = np.clip(np.mean([y for *_, y in examples]), 0.01, 0.99)
        b[:] = np.log([1 - share, share])
    total, done = epochs * max(1, len(examples)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            rate = lr * (1 - done / total)
            done += 1
            at, n, y = examples[k]
            f = n.astype(np.float32) / max(1, n.sum())
            mean = f @ e[at]
            z = mean @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= rate * np.outer(mean, p)
            b -= 0.1 * rate * p
            e[at] -= (rate * len(at) ** 0.5 * f)[:, None] * back
    return (e @ (w[:, 1] - w[:, 0])).astype(np.float32), float(b[1] - b[0])


def scores(texts: list[bytes | None], odds: np.ndarray, bias: float) -> np.ndarray:
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for doc, bucket in features(texts):
        cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        run = np.concatenate(([0.0], np.cumsum(odds[bucket], dtype=np.float64)))
        total += run[cut[1:]] - run[cut[:-1]]
        n += np.diff(cut)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -40, 40)))


def _gather(batches):
    for batch in batches:
        for b in slices(batch, SLICE):
            got = counted(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(2), pa.array([x.tobytes() for x, _ in got], pa.binary()), pa.array([n.tobytes() for _, n in got], pa.binary())], names=["y", "buckets", "counts"]
            )


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """Trains on about max_labelled labelled documents at most outside the held-out fold, chosen by a hash of doc_id.

    Equal texts with equal labels count once, so repeated rows do; of labels that contradict each other the
    greater counts; null ids, null labels and labels without a document are ignored.
    """
    usable = labels.filter(fold("doc_id", folds) != held_out).filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).cast("int").alias("y"))
    usable = materialize(usable, "quality-labels")
    chosen = usable.filter(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 20)) < int(min(1.0, max_labelled / max(1, usable.count())) * (1 << 20)))
    chosen = materialize(chosen, "quality-rows")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    rows = texts.mapInArrow(_gather, "y int, buckets binary, counts binary").distinct().toLocalIterator()
    unique = {(bytes(r.buckets), bytes(r.counts), r.y) for r in rows}
    return train([(np.frombuffer(x, np.int32), np.frombuffer(n, np.int32), y) for x, n, y in sorted(unique)])


def score(docs: DataFrame, model: tuple[np.ndarray, float], folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each input row.

    score uses the whole text only, so equal texts have equal scores; null and empty texts get the bias alone. A null doc_id has the fold of
    the empty text; repeated rows are scored each; an empty table gives an empty result; further columns
    are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        odds, bias = held.value
        for batch in batches:
            for b in slices(batch, SLICE):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(scores(b.column(1).to_pylist(), odds, bias))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), (fold("doc_id", folds) == held_out).alias("held_out"))
    out = rows.mapInArrow(scored, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_accepted(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier doesn't reject (score below THRESHOLD); nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def kept(batches):
        odds, bias = held.value
        for batch in batches:
            for b in slices(batch, SLICE):
                good = scores(b.column(1).to_pylist(), odds, bias) >= THRESHOLD
                rest = pa.RecordBatch.from_arrays(b.columns[2:], names=names)
                yield rest.filter(pa.array(good))

    rows = docs.select(F.lit(0).alias("_row"), F.col("text").cast("binary").alias("_bytes"), "*")
    return rows.mapInArrow(kept, docs.schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
