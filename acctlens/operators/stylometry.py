"""Style vectors: hashed character n-grams, structural features, function words."""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.canonical import sha256_of
from ..functions.text import PUNCTUATION, bucket, gram_key
from ..functions.vectors import fitted, standardize, unit
from ..schemas import ContractError
from ..session import kept

#: Dimensions of the structural block, and where the blocks begin in the joined vector.
STRUCTURAL = 38


def account_marks(messages: DataFrame) -> DataFrame:
    """What the structural features sum up: rows of (account_id, counts of some of its messages), each message counted once."""
    ranges = codes.kinds(messages.sparkSession)
    columns = ["double_space", *[f"p{i}" for i in range(len(PUNCTUATION))], "repeated", "upper", "alpha", "elongated", "emoji", "len", "n"]

    def run(batches):
        kind = codes.kind_table(ranges)
        for b in batches:
            accounts: dict = {}
            owner = codes.numbered(b.column(0).to_pylist(), accounts)
            out = {c: np.zeros(len(accounts), np.int64) for c in columns}
            for part, own in codes.with_rows(b, 1, owner):
                for c, n in codes.mark_counts(part.column(1), own, len(accounts), PUNCTUATION, kind).items():
                    out[c] += n
            out["n"] = np.bincount(owner, minlength=len(accounts))
            # An account whose texts are all null has no length.
            none = np.bincount(owner[b.column(1).is_valid().to_numpy(zero_copy_only=False)], minlength=len(accounts)) == 0
            yield pa.RecordBatch.from_arrays([pa.array(list(accounts), pa.string()), *[pa.array(out[c], mask=none if c == "len" else None) for c in columns]], names=["account_id", *columns])

    return messages.select("account_id", "text").mapInArrow(run, "account_id string, " + ", ".join(f"{c} long" for c in columns))


def structural(messages: DataFrame) -> DataFrame:
    """(account_id, idx, value) of the 38 structural features."""
    m = account_marks(messages)
    names = ["double_space", *[f"p{i}" for i in range(len(PUNCTUATION))], "repeated"]
    g = m.groupBy("account_id").agg(*[F.sum(c).alias(c) for c in [*names, "upper", "alpha", "elongated", "emoji", "len", "n"]])
    rate = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("len")), F.lit(0.0))
    values = [rate(c) for c in names] + [F.coalesce(F.try_divide(F.col("upper"), F.col("alpha")), F.lit(0.0)), rate("elongated"), rate("emoji"), F.col("len") / F.col("n")]
    pairs = F.array(*[F.struct(F.lit(i).alias("idx"), v.cast("double").alias("value")) for i, v in enumerate(values)])
    return g.select("account_id", F.explode(pairs).alias("p")).select("account_id", "p.idx", "p.value")


def listed_words(words) -> tuple[list[str], str]:
    """(the words as they are counted: casefolded, each once, sorted; digest of the list in NFC as it was given)."""
    if isinstance(words, (str, bytes)) or any(not isinstance(w, str) for w in words):
        raise ContractError("function_words")
    given = sorted({unicodedata.normalize("NFC", w.strip()) for w in words})
    if "" in given:
        raise ContractError("function_words")
    return sorted({w.casefold() for w in given}), sha256_of({"function_words": given, "language": "und"})


def function_words(messages: DataFrame, words) -> DataFrame:
    """(account_id, word, freq) for every word of the list, zeros included; freq is of all alphabetic tokens, casefolded."""
    listed, _ = listed_words(words)
    ranges, names = codes.kinds(messages.sparkSession), ["n", *[f"w{i}" for i in range(len(listed))]]

    def run(batches):
        counter = codes.word_counter(tuple(listed), ranges)
        for b in batches:
            accounts: dict = {}
            owner = codes.numbered(b.column(0).to_pylist(), accounts)
            out = np.zeros((len(accounts), len(names)), np.int64)
            for part, own in codes.with_rows(b, 1, owner):
                out += counter.count(part.column(1), own, len(accounts))
            yield pa.RecordBatch.from_arrays([pa.array(list(accounts), pa.string()), *map(pa.array, out.T.copy())], names=["account_id", *names])

    rows = messages.select("account_id", "text").mapInArrow(run, "account_id string, " + ", ".join(f"{c} long" for c in names))
    g = rows.groupBy("account_id").agg(*[F.sum(c).alias(c) for c in names]).filter("n > 0")
    pairs = F.array(*[F.struct(F.lit(w).alias("word"), (F.col(f"w{i}") / F.col("n")).alias("freq")) for i, w in enumerate(listed)])
    return g.select("account_id", F.explode(pairs).alias("p")).select("account_id", "p.word", "p.freq")


def plain_grams(messages: DataFrame, size: int = 2) -> DataFrame:
    """(account_id, message_id, gram, n): unhashed character n-grams, counted once for each message in Arrow batches."""

    def run(batches):
        for b in (part for batch in batches for part in codes.parts(batch, 2)):
            rows: list[tuple] = []
            for account, message, text in zip(*(c.to_pylist() for c in b.columns)):
                rows += [(account, message, g, n) for g, n in Counter(map("".join, zip(*(text[k:] for k in range(size))))).items()] if text else []
                if len(rows) > 200_000:
                    yield _gram_batch(rows)
                    rows = []
            yield _gram_batch(rows)

    return messages.select("account_id", "message_id", "text").mapInArrow(run, "account_id string, message_id string, gram string, n long")


def _gram_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["account_id", "message_id", "gram", "n"])


def account_grams(grams: DataFrame, dim: str = "gram") -> DataFrame:
    """(account_id, dim, n, df): an account's counts, and in how many of its messages each is. Both the idf and the tf derive from it, so grams are shuffled once."""
    return grams.groupBy("account_id", dim).agg(F.sum("n").alias("n"), F.count("*").alias("df"))


def account_plain_grams(messages: DataFrame, size: int = 2) -> DataFrame:
    """`account_grams` of `plain_grams`, added up before rows leave a task, and kept: idf and tf read different columns of them."""

    def run(batches):
        known: dict[str, int] = {}

        def emit(accounts, account, gram, n, df):
            names = pa.array(list(known), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(accounts, pa.string()).take(pa.array(account)), names.take(pa.array(gram)), pa.array(n), pa.array(df)], names=["account_id", "gram", "n", "df"])

        yield from codes.account_gram_counts(batches, (size,), lambda g: known.setdefault(g, len(known)), emit, known.clear)

    rows = messages.select("account_id", "text").mapInArrow(run, "account_id string, gram string, n long, df long")
    return kept(rows.groupBy("account_id", "gram").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "grams")


def account_hashed_grams(messages: DataFrame, sizes=(2, 3, 4), space: int = 262_144, seed: int = 1729, memo: int = 200_000, gathered: bool = False) -> DataFrame:
    """`account_grams` of `hashed_grams`, added up before rows leave a task, and kept: idf and tf read different columns of them. Grams are told to buckets by a bounded memo in each task.

    gathered: an account's messages are brought together first. With many accounts of short messages that shuffles
    less, as counts of accounts that lie apart can't be added up within a task.
    """
    key = gram_key(seed)

    def run(batches):
        known: dict[str, int] = {}

        def number_of(gram: str) -> int:
            k = known.get(gram)
            if k is None:
                k = bucket(gram, key, space)
                if len(known) < memo:
                    known[gram] = k
            return k

        def emit(accounts, account, at, n, df):
            return pa.RecordBatch.from_arrays([pa.array(accounts, pa.string()).take(pa.array(account)), pa.array(at.astype(np.int32)), pa.array(n), pa.array(df)], names=["account_id", "bucket", "n", "df"])

        yield from codes.account_gram_counts(batches, sizes, number_of, emit, space=space)

    texts = messages.select("account_id", "text")
    if gathered:
        texts = texts.repartition("account_id").sortWithinPartitions("account_id")
    rows = texts.mapInArrow(run, "account_id string, bucket int, n long, df long")
    return kept(rows.groupBy("account_id", "bucket").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "grams")


def idf(counts: DataFrame, n_messages: int, dim: str = "gram") -> DataFrame:
    """(dim, df, idf) with messages as documents, from `account_grams`."""
    g = counts.groupBy(dim).agg(F.sum("df").alias("df"))
    return g.withColumn("idf", F.ln((1 + F.lit(n_messages)) / (1 + F.col("df"))) + 1)


def tfidf(counts: DataFrame, idf_rows: DataFrame, n_messages: int, dim: str = "gram") -> DataFrame:
    """(account_id, idx, w): tf times idf, of unit length, from `account_grams`; a dim without idf has the largest one."""
    few = F.broadcast if dim == "bucket" else lambda df: df  # buckets have a bound, grams have none
    total = Window.partitionBy("account_id")
    default = F.ln(1 + F.lit(n_messages).cast("double")) + 1
    rows = counts.select("account_id", dim, "n").join(few(idf_rows.select(dim, "idf")), dim, "left").withColumn("w", F.col("n") / F.sum("n").over(total) * F.coalesce("idf", default))
    return unit(rows.select("account_id", F.col(dim).alias("idx"), "w"))


def style_vectors(messages: DataFrame, words, weights=(0.5, 0.25, 0.25), seed: int = 1729, space: int = 262_144, fitted_on: DataFrame | None = None, gathered: bool = False) -> DataFrame:
    """(account_id, idx, w): the weighted blocks (hashed n-grams, structural, function words) as one unit vector.

    The structural statistics and the idf are fitted on the messages of the accounts `fitted_on` (account_id), or on all.
    """
    own = (lambda df: df) if fitted_on is None else (lambda df: df.join(fitted_on.select("account_id").distinct(), "account_id", "left_semi"))
    counts = account_hashed_grams(messages, space=space, seed=seed, gathered=gathered)
    n = own(messages).count()
    first = tfidf(counts, idf(own(counts), n, "bucket"), n, "bucket").select("account_id", F.col("idx").cast("long").alias("idx"), (F.col("w") * weights[0]).alias("w"))
    rows = structural(messages)
    stats = fitted(own(rows))
    second = unit(standardize(rows, stats).select("account_id", "idx", F.col("z").alias("w"))).select("account_id", (F.col("idx") + space).cast("long").alias("idx"), (F.col("w") * weights[1]).alias("w"))
    freq = function_words(messages, words)
    place = F.create_map(*[F.lit(x) for i, w in enumerate(listed_words(words)[0]) for x in (w, i)])[F.col("word")]
    third = unit(freq.select("account_id", place.alias("idx"), F.col("freq").alias("w"))).select("account_id", (F.col("idx") + space + STRUCTURAL).cast("long").alias("idx"), (F.col("w") * weights[2]).alias("w"))
    return unit(first.union(second).union(third))
