"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Every passage of every document (overlapping windows of words) is a query. Half a passage has at least as many
words as the items that it is searched for, so that a copy of an item lies within one passage: items of up to
HALF words are one collection, and those of up to 2, 4, ... times as many are others with longer passages. All items that score at least
`least_score` of what they score against themselves are retrieved, then verified by the 5-word shingles of
their question and answer. Block bounds are first summed for many passages at once, which rules out most of
them exactly; the others are searched one by one, document at a time, with skipping by block bounds.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, prefix_hash, slices, span_hash, spans, table, unused

K1, B = 1.2, 0.75
#: Items of a block, words of half a passage (more for longer items), least share of an item's own score, and least shingle overlap.
BLOCK, HALF, LEAST_SCORE, LEAST_OVERLAP, WIDTH = 4, 64, 0.5, 0.8, 5
#: Most bytes of item texts in one broadcast index; more items are searched shard by shard.
SHARD_BYTES = 16 << 20
#: Bytes of text handled at once.
SLICE = 1 << 19
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the lower-cased words, where each text's begin)."""
    raw = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n" if raw else b"", np.uint8)
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in raw]))).astype(np.int64)
    start, end = spans(_WORD[data])
    return span_hash(prefix_hash(data), start, end), np.searchsorted(start, at)


def question_length(text: str) -> int:
    """Words before the answer, which is the last sentence; the last third where there is one sentence only."""
    words = lambda s: len(re.findall(rb"[0-9A-Za-z\x80-\xff]+", s.encode()))
    whole = words(text)
    ends = [m.end() for m in re.finditer(r"[.!?]\s+|\n+", text.rstrip())]
    for end in reversed(ends):
        n = words(text[:end])
        if 3 <= whole - n and n >= 3:
            return n
    return whole - max(1, whole // 3) if whole > 1 else whole


def half_for(n_words: int) -> int:
    """Words of half a passage for an item of n_words: HALF, or so many doublings of it that the item has no more."""
    half = HALF
    while half < n_words:
        half *= 2
    return half


def shingles(words: np.ndarray, width: int) -> set[bytes]:
    return {words[i : i + width].tobytes() for i in range(len(words) - width + 1)}


class Index:
    """Postings by term with BM25 impacts as shares of each item's own score, and their maxima by block.

    whole: (number of items, mean length, sorted terms, items of each term) of the collection that the items are part of; without it they are all.
    """

    def __init__(self, items: list[tuple[int, str | None]], block: int = BLOCK, whole: tuple[int, float, np.ndarray, np.ndarray] | None = None):
        words, cut = hashed_words([t for _, t in items])
        self.ids = [i for i, _ in items]
        self.words = [words[a:b] for a, b in zip(cut[:-1], cut[1:])]
        self.split = [question_length(t or "") for _, t in items]
        self.block = block
        n, size = len(items), np.array([len(w) for w in self.words], np.int64)
        self.terms = np.unique(words)
        item = np.repeat(np.arange(n), size)
        pair, tf = np.unique((np.searchsorted(self.terms, words) * max(1, n)) + item, return_counts=True)
        term, item = pair // max(1, n), pair % max(1, n)
        if whole is None:
            total, mean, df = n, size.mean() if n else 1, np.bincount(term, minlength=len(self.terms))
        else:
            total, mean, df = whole[0], whole[1], whole[3][np.searchsorted(whole[2], self.terms)]
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / max(1.0, mean)))
        own = np.bincount(item, impact, n)
        self.impact = impact / own[item]
        self.item, self.first = item, np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.blocks = -(-n // block)
        key, which = np.unique(term * max(1, self.blocks) + item // block, return_inverse=True)
        most = np.zeros(len(key))
        np.maximum.at(most, which, self.impact)
        self.b_most, self.b_block = most, key % max(1, self.blocks)
        self.b_first = np.searchsorted(key // max(1, self.blocks), np.arange(len(self.terms) + 1))
        self.b_key, self.item_list = key, item.tolist()
        self.b_start = np.concatenate((np.searchsorted(which, np.arange(len(key))), [len(item)]))

    def search(self, terms: np.ndarray, least: float, blocks=None) -> list[tuple[int, float]]:
        """(item, score) of all items that score at least `least` for the distinct terms, by block-max WAND.

        Only blocks whose bounds of all terms reach `least` are entered (`blocks`, if they are known already).
        Within one, a cursor for each term stands on its next item; an item is scored only where the bounds of
        the terms that have got to it suffice.
        """
        if blocks is None:
            blocks = np.flatnonzero(self.bounds(terms) >= least - 1e-9)
        out = []
        for b in blocks:
            key = terms * self.blocks + b
            k = np.minimum(np.searchsorted(self.b_key, key), len(self.b_key) - 1)
            k = k[self.b_key[k] == key]
            cursors = [[int(i), int(j), m] for i, j, m in zip(self.b_start[k], self.b_start[k + 1], self.b_most[k].tolist())]
            while cursors:
                cursors.sort(key=lambda c: self.item_list[c[0]])
                total, pivot = 0.0, None
                for c in cursors:
                    total += c[2]
                    if total >= least - 1e-12:
                        pivot = self.item_list[c[0]]
                        break
                if pivot is None:
                    break
                if self.item_list[cursors[0][0]] == pivot:
                    here = [c for c in cursors if self.item_list[c[0]] == pivot]
                    score = sum(float(self.impact[c[0]]) for c in here)
                    if score >= least:
                        out.append((pivot, score))
                    to = pivot + 1
                else:
                    to = pivot
                for c in cursors:
                    while c[0] < c[1] and self.item_list[c[0]] < to:
                        c[0] += 1
                cursors = [c for c in cursors if c[0] < c[1]]
        return out

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """For each block what its best item could score at most."""
        n = self.b_first[terms + 1] - self.b_first[terms]
        k = np.arange(n.sum()) + np.repeat(self.b_first[terms] - np.cumsum(n) + n, n)
        return np.bincount(self.b_block[k], self.b_most[k], self.blocks)

    def passages(self, words: np.ndarray, cut: np.ndarray, least: float, half: int = HALF):
        """Yields (text, first word, end, distinct terms, blocks) of every passage, with the blocks whose bounds reach `least`, if any do."""
        if not len(self.terms) or not len(words):
            return
        where = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        has = self.terms[where] == words
        halves = np.maximum(1, -(-np.diff(cut) // half))
        base = np.concatenate(([0], np.cumsum(halves)))
        doc = np.repeat(np.arange(len(halves)), np.diff(cut))
        own_half = base[doc] + (np.arange(len(words)) - cut[doc]) // half
        last = np.zeros(base[-1], bool)
        last[base[1:] - 1] = True
        # A passage is a half with the one after it; a text of one half is a passage by itself.
        n_terms = len(self.terms)
        h, t = own_half[has], where[has]
        before = h - 1
        joins = np.zeros(len(h), bool)
        ok = before >= 0
        joins[ok] = ~last[before[ok]]
        both = np.unique(np.concatenate((h * n_terms + t, before[joins] * n_terms + t[joins])))
        p, t = both // n_terms, both % n_terms
        rows = max(1, min(int(base[-1]), (4 << 20) // max(1, self.blocks)))
        for lo in range(0, base[-1], rows):
            a, b = np.searchsorted(p, [lo, lo + rows])
            n = self.b_first[t[a:b] + 1] - self.b_first[t[a:b]]
            k = np.arange(n.sum()) + np.repeat(self.b_first[t[a:b]] - np.cumsum(n) + n, n)
            bounds = np.bincount((np.repeat(p[a:b], n) - lo) * self.blocks + self.b_block[k], self.b_most[k], rows * self.blocks)
            bounds = bounds.reshape(rows, self.blocks) >= least - 1e-9
            for q in lo + np.flatnonzero(bounds.any(axis=1)):
                d = int(np.searchsorted(base, q, "right")) - 1
                i, j = np.searchsorted(p, [q, q + 1])
                first = int(cut[d]) + (int(q) - int(base[d])) * half
                yield d, first, min(first + 2 * half, int(cut[d + 1])), t[i:j], np.flatnonzero(bounds[q - lo])

    def overlap(self, words: np.ndarray, item: int) -> tuple[float, float]:
        """Shares of the shingles of the item's question and of its answer that `words` has."""
        w, k = self.words[item], self.split[item]
        share = []
        for part in (w[:k], w[k:]):
            width = max(1, min(WIDTH, len(part)))
            own = shingles(part, width)
            share.append(len(own & shingles(words, width)) / len(own) if own else 1.0)
        return share[0], share[1]

    def leaks(self, words: np.ndarray, cut: np.ndarray, least_score: float, least_overlap: float, half: int = HALF) -> dict:
        """(text, item) -> (score, question overlap, answer overlap) of the verified ones."""
        out: dict = {}
        for d, first, end, terms, blocks in self.passages(words, cut, least_score, half):
            for item, score in self.search(terms, least_score, blocks):
                more = len(self.words[item])
                q, a = self.overlap(words[max(int(cut[d]), first - more) : min(int(cut[d + 1]), end + more)], item)
                if q >= least_overlap and a >= least_overlap:
                    out[d, item] = max(out.get((d, item), (0.0, 0.0, 0.0)), (score, q, a))
        return out


def collection(items: DataFrame) -> tuple[DataFrame, int, float]:
    """((shard, term, df): the terms of each shard's items and in how many items of all a term is; number and mean length of the items with words).

    items: (shard, item_id, text), one row for each item.
    """

    def listed(batches):
        for b in batches:
            words, cut = hashed_words(b.column(1).to_pylist())
            own = [np.unique(words[i:j]) for i, j in zip(cut[:-1], cut[1:])]
            n = np.array([len(x) for x in own], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(cut).astype(np.int64)), lists], names=["shard", "size", "terms"])

    rows = materialize(items.select("shard", "text").mapInArrow(listed, "shard int, size long, terms array<long>").filter("size > 0"), "items-terms")
    n, mean = rows.agg(F.count("*"), F.coalesce(F.avg("size"), F.lit(1.0))).first()
    each = rows.select("shard", F.explode("terms").alias("term")).groupBy("term", "shard").agg(F.count("*").alias("n"))
    df = each.groupBy("term").agg(F.sum("n").alias("df"))
    return materialize(each.select("term", "shard").join(df, "term"), "items-df"), int(n), float(mean)


def contaminated(docs: DataFrame, items: DataFrame, least_score: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): documents with a passage that holds a test item.

    Both the question and the answer must overlap. Document frequencies and lengths are those of all items.
    Postings are broadcast in shards of about shard_bytes of item texts, one index for each class of lengths
    (see half_for), and each shard is searched with every passage of every document: results and scores don't
    depend on the shards, but documents are read once for each of them. Items without words or with a null
    id and documents without words or a null doc_id match nothing; repeated rows of either give one row; items
    with an equal id and other texts are items each, and the best one counts; empty tables give an empty
    result; further columns are ignored.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    spark = docs.sparkSession
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // shard_bytes))
    own = own.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int").alias("shard"), "text", "item_id")
    terms, n_items, mean = collection(own)
    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    found = None
    for s in range(shards):
        part = sorted((r.item_id, r.text) for r in own.filter(F.col("shard") == s).toLocalIterator())
        known = np.array(sorted((r.term & (2**64 - 1), r.df) for r in terms.filter(F.col("shard") == s).toLocalIterator()), np.uint64).reshape(-1, 2)
        whole = (n_items, mean, known[:, 0], known[:, 1].astype(np.int64))
        by_half: dict = {}
        for x in part:
            if n := len(hashed_words([x[1]])[0]):
                by_half.setdefault(half_for(n), []).append(x)
        held = spark.sparkContext.broadcast([(half, Index(x, whole=whole)) for half, x in sorted(by_half.items())])

        def search(batches, held=held):
            for batch in batches:
                for b in slices(batch, SLICE):
                    words, cut = hashed_words(b.column(1).to_pylist())
                    ids = b.column(0).to_pylist()
                    flat = []
                    for half, index in held.value:
                        got = index.leaks(words, cut, least_score, least_overlap, half)
                        flat += [(ids[d], index.ids[i], *x) for (d, i), x in sorted(got.items())]
                    columns = [pa.array(list(c), k) for c, k in zip(zip(*flat) if flat else [[]] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        some = rows.mapInArrow(search, schema)
        if shards > 1:
            some = materialize(some, "leaks")
            held.unpersist()
        found = some if found is None else found.union(some)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, whose doc_id is not in `contaminated`; rows with a null doc_id stay."""
    key = unused(docs, "contaminated_id")
    bad = materialize(contaminated(docs, items).select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return docs.join(bad, F.col(key) == F.col("doc_id").cast("long"), "left_anti")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
