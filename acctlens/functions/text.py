"""Text functions: masking in SQL and in exact form, casefolding, tokens, hashed n-grams."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codes import parts

#: The replacement tokens, in the order of the masking chain.
USER, URL, NUM, TERM = "[USER]", "[URL]", "[NUM]", "[GAME_TERM]"
#: ASCII punctuation counted by the structural features, in feature order.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


#: What the masking chain replaces besides listed terms.
MENTIONS, URLS, NUMBERS = r"(?<!\w)@[\w.-]+", r"\b(?:https?://|www\.)[^\s]+", r"(?<!\w)\d+(?:[.,]\d+)*(?!\w)"


class Terms:
    """A list of terms as a tree of characters, so that matching goes through common beginnings once.

    Terms are NFC and without empty ones; of account names a leading @ is no part.
    """

    def __init__(self, terms, names: bool = False):
        self.names, self.root = names, {}
        for term in terms:
            node = self.root
            for c in unicodedata.normalize("NFC", term.lstrip("@") if names else term):
                # Case doesn't count in matching, so it must not part the tree.
                node = node.setdefault(c.lower() if len(c.lower()) == 1 else c, {})
            if node is not self.root:
                node[""] = {}

    def _alternatives(self, node: dict) -> str:
        """Pattern of all that can follow; longer ends come before shorter ones."""
        ways = [re.escape(c) + self._alternatives(below) for c, below in sorted(node.items()) if c]
        body = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})" if ways else ""
        return body + "?" if ways and "" in node else body

    def pattern(self) -> str | None:
        """Regular expression (of Python and of Java) for terms that stand as words; names may carry an @."""
        if not self.root:
            return None
        before = r"(?<![\w@])@?" if self.names else r"(?<!\w)"
        return f"{before}{self._alternatives(self.root)}(?!\\w)"


def masking_steps(usernames=(), game_terms=()) -> list[tuple[str, str]]:
    """(pattern, replacement) of the masking chain, in its order."""
    steps = [(Terms(usernames, True).pattern(), USER), (MENTIONS, USER), (URLS, URL), (NUMBERS, NUM), (Terms(game_terms).pattern(), TERM)]
    return [x for x in steps if x[0]]


def masker(usernames=(), game_terms=()):
    """The exact masking of one text, as a Python function."""
    steps = [(re.compile(p, re.IGNORECASE), r) for p, r in masking_steps(usernames, game_terms)]

    def mask(text: str) -> str:
        out = unicodedata.normalize("NFC", text)
        for p, r in steps:
            out = p.sub(r, out)
        return " ".join(out.split())

    return mask


def mask_exact(df: DataFrame, column: str = "text", out: str = "masked", usernames=(), game_terms=()) -> DataFrame:
    """df with the masked text; batches pass through Arrow, a part of about a megabyte of text at a time."""
    mask = masker(usernames, game_terms)
    at = df.columns.index(column)
    schema = df.withColumn(out, F.lit("")).schema

    def run(batches):
        for b in (part for batch in batches for part in parts(batch, at)):
            done = [None if t is None else mask(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def mask_sql(text: Column, usernames=(), game_terms=()) -> Column:
    """The masking chain in SQL, for text that is NFC already; the same but for characters that Java's \\w leaves out."""
    for p, r in masking_steps(usernames, game_terms):
        text = F.regexp_replace(text, "(?Ui)" + p, r)
    return collapse(text)


def mask_urls(text: Column) -> Column:
    return F.regexp_replace(text, "(?Ui)" + URLS, URL)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _foldings() -> tuple[str, str, dict[str, str]]:
    """Where casefolding differs from lower-casing: letters and what they become, and those that become several letters."""
    single, several = {}, {}
    for c in map(chr, range(128, 0x110000)):
        low = c.lower()
        for x in low:
            if x.casefold() != x:
                (single if len(x.casefold()) == 1 else several)[x] = x.casefold()
    return "".join(single), "".join(single.values()), several


_FROM, _TO, _SEVERAL = _foldings()


def casefold(text: Column) -> Column:
    """Python's str.casefold, in the JVM: lower-cased, then the letters that fold further, which few texts have."""
    low = F.lower(text)
    folded = F.translate(low, _FROM, _TO)
    for c, to in _SEVERAL.items():
        folded = F.replace(folded, F.lit(c), F.lit(to))
    return F.when(F.regexp_like(low, F.lit(f"[{_FROM}{''.join(_SEVERAL)}]")), folded).otherwise(low)


def alphabetic_tokens(text: Column) -> Column:
    """Maximal runs of letters, casefolded one by one."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}+)")), casefold)


def casefolded_tokens(text: str) -> list[str]:
    """The same in Python, for comparison."""
    return [t.casefold() for t in "".join(c if c.isalpha() else "\0" for c in text).split("\0") if t]


#: Key and personal string of the n-gram hash.
GRAM_KEY, GRAM_PERSON = "stylometry-ngram-v1:{seed}", b"styl-ngram-v1"


def gram_key(seed: int) -> bytes:
    return hashlib.sha256(GRAM_KEY.format(seed=seed).encode()).digest()


def bucket(gram: str, key: bytes, space: int) -> int:
    h = hashlib.blake2b(gram.encode(), digest_size=8, key=key, person=GRAM_PERSON)
    return int.from_bytes(h.digest(), "big") % space


def hashed_grams(messages: DataFrame, sizes=(2, 3, 4), space: int = 262_144, seed: int = 1729, memo: int = 1_000_000) -> DataFrame:
    """(account_id, message_id, bucket, n): hashed character n-grams of each message, never across messages.

    Grams are told to buckets by a bounded memo in each task; a message's counts are kept together.
    """
    key = gram_key(seed)

    def run(batches):
        known: dict[str, int] = {}
        for b in (part for batch in batches for part in parts(batch, 2)):
            rows: list[tuple] = []
            for account, message, text in zip(*(c.to_pylist() for c in b.columns)):
                grams = Counter(text[i : i + n] for n in sizes for i in range(len(text) - n + 1)) if text else Counter()
                at: Counter = Counter()
                for g, n in grams.items():
                    k = known.get(g)
                    if k is None:
                        k = bucket(g, key, space)
                        if len(known) < memo:
                            known[g] = k
                    at[k] += n
                rows += [(account, message, k, n) for k, n in at.items()]
                if len(rows) > 200_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    def _batch(rows):
        a, m, k, n = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(m, pa.string()), pa.array(k, pa.int32()), pa.array(n, pa.int64())], names=["account_id", "message_id", "bucket", "n"])

    return messages.select("account_id", "message_id", "text").mapInArrow(run, "account_id string, message_id string, bucket int, n long")
