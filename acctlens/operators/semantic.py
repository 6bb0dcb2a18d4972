"""Semantic engine: WordPiece windows, an embedding protocol with a cache, pooling and cosines."""

from __future__ import annotations

import hashlib
import unicodedata
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import parts
from ..schemas import ContractError, ErrorCode


class EmbeddingModel(Protocol):
    model_fingerprint: str
    embedding_dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class SyntheticModel:
    """A deterministic stand-in: length, code-point sum and one."""

    model_fingerprint, embedding_dim = "synthetic-3", 3

    def embed(self, texts):
        return [[float(len(t) + 1), float(sum(map(ord, t)) % 97 + 1), 1.0] for t in texts]


def _is_punctuation(c: str) -> bool:
    n = ord(c)
    return 33 <= n <= 47 or 58 <= n <= 64 or 91 <= n <= 96 or 123 <= n <= 126 or unicodedata.category(c).startswith("P")


def _is_cjk(c: str) -> bool:
    #: Blocks of ideographs.
    blocks = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
    return any(a <= ord(c) <= b for a, b in blocks)


def basic_tokens(text: str) -> list[tuple[int, int]]:
    """Spans of words, with punctuation and ideographs by themselves."""
    out, start = [], None
    for i, c in enumerate(text):
        gap = c.isspace() or unicodedata.category(c) in ("Cc", "Cf")
        alone = not gap and (_is_punctuation(c) or _is_cjk(c))
        if (gap or alone) and start is not None:
            out.append((start, i))
            start = None
        if alone:
            out.append((i, i + 1))
        elif not gap and start is None:
            start = i
    return [*out, (start, len(text))] if start is not None else out


def pieces(word: str, vocab: dict[str, int], most: int = 100) -> list[int]:
    """Greedy longest-first WordPiece ids of one word."""
    plain = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) not in ("Mn", "Mc", "Me"))
    unknown = [vocab["[UNK]"]]
    if len(plain) > most:
        return unknown
    ids, at = [], 0
    while at < len(plain):
        end = len(plain)
        while end > at and (key := ("##" if at else "") + plain[at:end]) not in vocab:
            end -= 1
        if end == at:
            return unknown
        ids.append(vocab[key])
        at = end
    return ids


def windows(text: str, vocab: dict[str, int], max_tokens: int = 256) -> list[tuple[str, list[int]]]:
    """Slices of the text with their ids, [CLS] and [SEP] around at most max_tokens - 2 pieces, cut between words; joined they give the text."""
    room, out, begin, held = max_tokens - 2, [], 0, []
    framed = lambda ids: [vocab["[CLS]"], *ids, vocab["[SEP]"]]
    if room < 1:
        raise ContractError("max_tokens", ErrorCode.INPUT_INVALID)
    for start, end in basic_tokens(text):
        ids = pieces(text[start:end], vocab)
        if held and len(held) + len(ids) > room:
            out.append((text[begin:start], framed(held)))
            begin, held = start, []
        held = held + (ids if len(ids) <= room else [vocab["[UNK]"]])
    if text[begin:] or not out:
        out.append((text[begin:], framed(held)))
    return out


def window_rows(texts: DataFrame, vocab: dict[str, int], max_tokens: int = 256) -> DataFrame:
    """(id, window, text, ids, key) of each text (id, text); key identifies text and ids without holding them. Short texts that come again are cut once in a task."""

    def cut(t: str) -> list[tuple]:
        return [(k, s, ids, hashlib.sha256(hashlib.sha256(s.encode()).digest() + repr(ids).encode()).hexdigest()) for k, (s, ids) in enumerate(windows(t, vocab, max_tokens))]

    def run(batches):
        known: dict[str, list[tuple]] = {}
        # Ids take many times the room of their text, so little text is handled at once.
        for b in (part for batch in batches for part in parts(batch, 1, 1 << 17)):
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = t or ""
                found = known.get(t)
                if found is None:
                    found = cut(t)
                    if len(t) <= 200 and len(known) < 4096:
                        known[t] = found
                rows += [(i, *w) for w in found]
            c = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string()), pa.array(c[3], pa.list_(pa.int32())), pa.array(c[4], pa.string())], names=["id", "window", "text", "ids", "key"])

    return texts.select(F.col(texts.columns[0]).cast("string"), texts.columns[1]).mapInArrow(run, "id string, window int, text string, ids array<int>, key string")


def embed(window_table: DataFrame, model: EmbeddingModel, cache: DataFrame | None = None, external: bool = False, allow_external: bool = False) -> tuple[DataFrame, DataFrame]:
    """(embeddings by key, those of them that the cache lacked). External providers must be allowed explicitly."""
    if external and not allow_external:
        raise ContractError("embedding_model", ErrorCode.EXTERNAL_NOT_ALLOWED)
    wanted = window_table.select("key", "text").dropDuplicates(["key"])
    missing = wanted if cache is None else wanted.join(cache.select("key"), "key", "left_anti")

    def run(batches):
        for b in (part for batch in batches for part in parts(batch, 1, 1 << 17)):
            vectors = model.embed(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["key", "embedding"])

    new = missing.mapInArrow(run, "key string, embedding array<float>")
    old = None if cache is None else cache.join(wanted.select("key"), "key", "left_semi").select("key", "embedding")
    return (new if old is None else old.union(new)), new


def mean_pool(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, idx, value): mean of each dimension."""
    return rows.select(group, F.posexplode(vector).alias("idx", "v")).groupBy(group, "idx").agg(F.avg(F.col("v").cast("double")).alias("value"))


def centred(pooled: DataFrame, centre: DataFrame) -> DataFrame:
    """pooled minus the centre (idx, centre), which has a row for each dimension."""
    return pooled.join(F.broadcast(centre), "idx").select(*[c for c in pooled.columns if c != "value"], (F.col("value") - F.col("centre")).alias("value"))
