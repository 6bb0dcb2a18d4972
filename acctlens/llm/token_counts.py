"""Token counts of whole texts by a two-tier lookup on the map side.

Tier one is a compact table of the token counts of frequent pre-tokens, broadcast to every task; its size
is bounded by `table_size`. Misses are encoded and kept in a bounded cache of the worker. Nothing is
shuffled. The table only decides what is fast: a pre-token that it lacks is encoded, so results don't
depend on it.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

#: Pre-tokens in the broadcast table, documents that they are counted in (on average), and entries of a worker's cache.
TABLE_SIZE, SAMPLE_DOCS, CACHE_SIZE = 50_000, 2_000, 400_000
LIMIT = 1024


class PretokenLengths(dict):
    """Pre-token -> number of tokens; what is missing is encoded and kept while there is room."""

    def __init__(self, path: str | None, known: dict[str, int], room: int = CACHE_SIZE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        super().__init__(known)
        self.most = len(known) + room
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.sign = os.path.commonprefix(special)
        self.words = regex.compile(public_tokenizers.PATTERN).findall

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(self) < self.most:
            self[piece] = n
        return n

    def parts(self, text: str) -> tuple[int, list[str]]:
        """Number of special strings, which are a token each, and the texts between them."""
        if self.special is None or self.sign not in text:
            return 0, [text]
        between = self.special.split(text)
        return len(between) - 1, between

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        n, between = self.parts(text)
        get = self.__getitem__
        return n + sum(sum(map(get, self.words(t))) for t in between if t)


#: The one reader that a worker keeps from task to task, under the name of the call that it belongs to.
_KEPT: dict[str, PretokenLengths] = {}


def _reader(name: str, path: str | None, known) -> PretokenLengths:
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = PretokenLengths(path, known.value)
    return _KEPT[name]


def _frequent(docs: DataFrame, path: str | None, sample_docs: int, table_size: int) -> dict[str, int]:
    """The most frequent pre-tokens of a hashed sample of about sample_docs documents, with their token counts."""
    every = max(1, docs.count() // sample_docs)
    sample = docs.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(every)) == 0).select("doc_id", "text")

    def pieces(batches):
        seen, reader = Counter(), PretokenLengths(path, {})
        for b in batches:
            for text in b.column(1).to_pylist():
                if text:
                    for t in reader.parts(text)[1]:
                        seen.update(reader.words(t))
        top = [(p, n) for p, n in seen.most_common(table_size) if n > 1]
        lengths = [reader[p] for p, _ in top]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64()), pa.array(lengths, pa.int32())], names=["piece", "n", "tokens"])

    total, lengths = Counter(), {}
    for r in sample.mapInArrow(pieces, "piece string, n long, tokens int").toLocalIterator():
        total[r.piece] += r.n
        lengths[r.piece] = r.tokens
        if len(total) > 4 * table_size:
            total = Counter(dict(total.most_common(2 * table_size)))
            lengths = {p: lengths[p] for p in total}
    return {p: lengths[p] for p, _ in total.most_common(table_size)}


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each input row.

    path: a byte-level BPE file of the `tokenizers` library (default: the public byte_bpe_50k.json, as
    installed on each worker). Whole texts count, however long; null and empty texts have zero bytes and
    tokens; special strings within texts are one token each, as the library has it; repeated rows are
    counted each; further columns are ignored.
    """
    known = docs.sparkSession.sparkContext.broadcast(_frequent(docs, path, sample_docs, table_size))
    name = uuid.uuid4().hex

    def counted(batches):
        lengths = _reader(name, path, known)
        for b in batches:
            n = [lengths.count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.array(n, np.int64))], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
