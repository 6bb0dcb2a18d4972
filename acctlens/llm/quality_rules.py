"""Quality rules as a bitmask ledger, in DataFrame functions only.

`ledger` evaluates every rule once per document and keeps a bit for each failed rule with the
measurements behind it. Policies are versioned masks over those bits, applied afterwards without reading
texts again; `ablations` counts from the bits what each rule of a policy decides alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

#: Bit of each rule. The thresholds are in `_failures`.
RULES = ("few_words", "repeated_windows", "symbols", "upper_case", "repeated_lines", "word_length")
#: Policy version -> the rules that reject a document.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "upper_case", "repeated_lines", "word_length"),
}
CURRENT_POLICY = 2
_SPACE = "[\\x20\\x09-\\x0D]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def mask(policy: int) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[policy])


def _let(value, body):
    """body(value), with value evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words):
    """Words inside 5-word windows that occur twice or more in the text, the first occurrence included."""

    def covered(starts):
        step = F.transform(starts, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(starts, k + 1) - x, F.lit(5))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def repeated(pairs):
        at = F.transform(pairs, lambda x, k: F.when(F.coalesce(x["h"] == F.get(pairs, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(pairs, k + 1)["h"], F.lit(False)), x["i"]))
        return _let(F.sort_array(F.filter(at, lambda x: x.isNotNull())), covered)

    def in_windows(hashes):
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, repeated))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.xxhash64(F.slice(words, i, 5)))
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(_let(hashes, in_windows))


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and what the rules measure, one row for each input row; a null text measures as an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, f"{_SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    without = lambda s: F.length(text) - F.length(F.translate(text, s, ""))
    of_words = _let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    m = docs.select(F.col("doc_id").cast("long"), of_words.alias("w"), of_lines.alias("x"), without("#*$%&|<>").alias("n_symbols"), without(_UPPER).alias("n_upper"))
    named = ("w.n_words", "w.word_chars", "n_symbols", "x.n_dup_lines", "w.n_repeat_words", "x.n_lines", "n_upper")
    return m.select("doc_id", *[F.col(c).cast("long").alias(c.split(".")[-1]) for c in named])


def _failures() -> dict:
    c = F.col
    return {
        "few_words": c("n_words") < 10,
        "repeated_windows": 100 * c("n_repeat_words") > 20 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 10 * c("word_chars"),
        "upper_case": 100 * c("n_upper") > 50 * c("word_chars"),
        "repeated_lines": (c("n_lines") >= 4) & (100 * c("n_dup_lines") > 30 * c("n_lines")),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
    }


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and fail_bits: bit i is set where RULES[i] fails.

    One row for each input row, repeated ones included; null and empty texts have zero words and fail
    few_words; an empty table gives an empty result; further columns of docs are ignored.
    """
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(_failures()[rule], F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measurements(docs).withColumn("fail_bits", bits)


def apply_policy(marked: DataFrame, policy: int = CURRENT_POLICY) -> DataFrame:
    """marked with `kept`: no rule of that policy version failed."""
    return marked.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablations(marked: DataFrame, policy: int = CURRENT_POLICY) -> DataFrame:
    """For each rule of the policy: documents that fail it, that only it rejects, and that would be kept without it.

    Documents are first counted by their bits (2**len(RULES) groups at most), then the few groups are compared.
    """
    whole = mask(policy)
    groups = marked.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))
    each = groups.select("fail_bits", "n", rules.alias("r")).select("fail_bits", "n", "r.*")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    fails = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).bitwiseAND(F.bitwise_not("bit"))
    return each.groupBy("rule").agg(count(fails)("failing"), count(fails & (rest == 0))("only_this"), count(rest == 0)("kept_without"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    marked = apply_policy(ledger(table(spark, sf_dir, "documents")))
    failed = c("fail_bits").bitwiseAND(F.lit(mask(1)).cast("long")) != 0
    return marked.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "n_lines", "n_upper", "fail_bits")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT k, generate_subscripts(ws, 1) AS p, ws FROM w),
h AS (SELECT k, p, array_to_string(ws[p:p + 4], ' ') AS win FROM g WHERE p + 4 <= len(ws)),
r AS (SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY k, win) AS n FROM h) WHERE n > 1),
c AS (SELECT k, count(DISTINCT q) AS n FROM (SELECT k, unnest(range(p, p + 5)) AS q FROM r) GROUP BY k),
l AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
      FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (SELECT d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(array_to_string(w.ws, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(l.n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(l.n_lines, 0) AS BIGINT) AS n_lines,
        CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
      FROM d JOIN w USING (k) LEFT JOIN c USING (k) LEFT JOIN l USING (k)),
f AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 100 * n_symbols > 10 * word_chars THEN 4 ELSE 0 END + CASE WHEN 100 * n_upper > 50 * word_chars THEN 8 ELSE 0 END
        + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 32 ELSE 0 END AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  bits = 0 AS kept, n_lines, n_upper, CAST(bits AS BIGINT) AS fail_bits FROM f
"""
