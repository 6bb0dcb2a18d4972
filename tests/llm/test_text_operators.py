"""SimHash, token counts and quality rules against brute force on small fixtures."""

import itertools
import random
import re
from collections import Counter

import pytest
import xxhash

from acctlens.llm import quality_rules, simhash, token_counts
from acctlens.llm.components import components

SCHEMA = "doc_id long, text string, fp string, n_words int, component string"
ODD = [None, "", " \t\n ", "One", "a b", "É ß İ x y", "tie tie tie tie tie tie tie", "x" * 300_000, "w " * 60_000, "<|endoftext|> a <|endoftext|>b", "don't 123 ... \r\n\n  z"]


def brute_fp(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, nodes):
    at = {n: n for n in nodes}

    def top(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        at[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("hot", [1 << 30, 2])
def test_simhash_matches_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_SEGMENT", hot)
    rng = random.Random(3)
    texts = list(ODD)
    for _ in range(12):
        words = [rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(400)]
        for _ in range(6):
            copy = list(words)
            copy[rng.randrange(400)] = "other"
            texts.append(" ".join(copy))
    texts += texts[-3:]
    rows = [(i, t, "clash", 1, "x") for i, t in enumerate(texts)] + [(len(texts) - 1, texts[-1], None, None, None), (None, "a b", None, None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    fp = {i: brute_fp(t) for i, t in enumerate(texts)}
    want = brute_components(((a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 3), fp)
    assert len(set(want.values())) < len(want) - 10
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == sorted([(i, f"{fp[i]:016x}", want[i]) for i in fp] + [(len(texts) - 1, f"{fp[len(texts) - 1]:016x}", want[len(texts) - 1])])
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_links_of_random_close_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SEGMENT", 3)
    rng = random.Random(5)
    fps = set()
    for _ in range(8):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "node long, fp long")
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(enumerate(fps), 2) if (x ^ y).bit_count() <= 3}
    assert {tuple(r) for r in simhash.links(df).collect()} == want and want


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 180)] + [tuple(sorted(rng.sample(range(200, 400), 2))) for _ in range(120)]
    nodes = {n for e in edges for n in e}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components(edges, nodes)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_counts_match_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("ab 'st\n\t1²½٣éß中🙂.,-_<|>") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    rows = [(i, x, "", 0, "") for i, x in enumerate(texts)] + [(0, None, None, None, None)]
    got = token_counts.token_counts(spark.createDataFrame(rows, SCHEMA), table_size=50).collect()
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(texts)] + [(0, 0, 0)]
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((*w, w[2] > 1024) for w in want)
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_match_brute_force(spark):
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choice(["a", "b", "C!", "d\n", "#|e"]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    marked = quality_rules.ledger(spark.createDataFrame([(i, x, "", 0, "") for i, x in enumerate(texts)], SCHEMA))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in marked.collect()}
    assert got == {i: brute_rules(x) for i, x in enumerate(texts)}
    rows = quality_rules.apply_policy(marked).collect()
    for r in quality_rules.ablations(marked).collect():
        bit = 1 << quality_rules.RULES.index(r.rule)
        assert r.failing == sum(bool(x.fail_bits & bit) for x in rows) and r.only_this == sum(x.fail_bits == bit for x in rows)
        assert r.kept_without == sum(x.fail_bits & ~bit == 0 for x in rows)
    assert quality_rules.ledger(spark.createDataFrame([], SCHEMA)).count() == 0
