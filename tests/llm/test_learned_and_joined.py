"""Toxicity, quality, LM scores, decontamination, line dedup, mixing, WARC and the pipeline on small fixtures."""

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from acctlens.llm import decontaminate, line_dedup, lm_scoring, mixing, quality, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, fp string"


def docs_of(spark, texts, sources=("a", "b", "c")):
    rows = [(i, t, "en", sources[i % len(sources)], len(t or ""), 1, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sentence(rng, n=12, words=300):
    return " ".join(f"w{rng.randrange(words)}x" for _ in range(n))


def fold(i, k):
    return zlib.crc32(str(i).encode()) % k


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        words = sentence(rng, 40).split()
        if bad:
            for w in rng.sample(["vilea", "scumb", "nastyc"], 2):
                words[rng.randrange(40)] = w
        texts.append(" ".join(words))
        labels.append((i, int(bad)))
    texts += [None, "", "y" * 200_000]
    df = docs_of(spark, texts)
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, lab)).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.held_out == (fold(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.predicted, dict(labels)[r.doc_id]) for r in got if r.held_out and r.doc_id < 900]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), none)).count() == 0


def test_nonnegative_risk_reverses_an_overfit_step():
    p = [np.array([1, 2])] * 8
    w, b = toxicity.train(p, [np.array([1, 2]), np.array([3])] * 8, 0.5, epochs=30, least_docs=1)
    assert np.isfinite(b) and np.isfinite(w).all() and w[1] + w[2] > w[3]


def test_quality_held_out_and_equal_scoring(spark):
    rng = random.Random(2)
    texts = [sentence(rng, 30).upper() + "!!" if i % 4 == 0 else sentence(rng, 30) + "." for i in range(500)] + [None, "", "a", "é" * 100_000]
    df = docs_of(spark, texts)
    lab = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(500)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(df, lab)
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    held = [(r.predicted, int(i % 4 != 0)) for i, r in got.items() if r.held_out and i < 500]
    assert held and sum(p == y for p, y in held) / len(held) > 0.97
    # The mean over counted features gives the same as the pass that keeps text order.
    odds, bias = model
    for i, (at, n) in enumerate(quality.counted([(t or "").encode() for t in texts[:20]])):
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-((odds[at] * n).sum() / max(1, n.sum()) + bias))), abs=1e-5)
    kept = quality.keep_accepted(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    assert quality.score(df.limit(0), model).count() == 0


def test_lm_base_and_attention(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SLICE", 3000)
    rng = random.Random(3)
    texts = [sentence(rng, rng.randint(1, 60), 40) for _ in range(150)] + [None, "", " \n", "z" * 50_000, "É SS é"] + ["same text"] * 3 + [sentence(rng, 3000, 5000)]
    df = docs_of(spark, texts)
    df = df.union(df.filter("doc_id = 5")).union(df.filter("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    all_texts = [*enumerate(texts), (5, texts[5]), ("", texts[6])]
    got = lm_scoring.lm_scores(df, max_frequent=20, fit_every=2).collect()
    words = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + ["end"]) for i, t in all_texts]
    c = Counter(w for i, ws in words if fold(i, 10) != 0 for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(words) and Counter(r.doc_id for r in got)[5] == 2
    by_id = dict(words)
    for r in got:
        i = "" if r.doc_id is None else r.doc_id
        ws = by_id[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 10) == 0, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert r.score < 0
    assert lm_scoring.lm_scores(df.limit(0)).count() == 0
    only_held_out = df.filter(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0)
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in lm_scoring.lm_scores(only_held_out).collect())


def test_long_texts_in_pieces_score_as_whole(monkeypatch):
    import pyarrow as pa

    rng = random.Random(33)
    texts = [sentence(rng, n).encode() for n in (3, 500, 0, 900, 40)] + [b"x" * 5000 + b" y", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.binary())], names=["a", "b"])
    subwords = lm_scoring.Subwords(None)
    whole, cut = lm_scoring.Words(texts).stream(subwords, 7)
    ids, sizes = [], []
    for start, k, got, at, pieces in lm_scoring.streams(batch, subwords, 700):
        assert sum(len(w.hash) for w in pieces) == sum(len((t or b"").split()) for t in texts[start : start + k])
        ids.append(got)
        sizes += np.diff(at).tolist()
    assert np.array_equal(np.concatenate(ids), whole) and sizes == np.diff(cut).tolist()
    for t in texts:
        got = lm_scoring.parts(t, 100)
        assert b"".join(got) == (t or b"") and [w for x in got for w in x.split()] == (t or b"").split()


def test_lm_learns_more_than_the_base(spark):
    """Held-out log10 probability a word: words that follow from the one before, which the base can't know."""
    rng = random.Random(23)
    after = {f"{a}": [f"{b}" for b in rng.sample(NAMES, 2)] for a in NAMES}

    def chain_of(n):
        w = [rng.choice(NAMES)]
        while len(w) < n:
            w.append(rng.choice(after[w[-1]]))
        return " ".join(w)

    got = lm_scoring.lm_scores(docs_of(spark, [chain_of(60) for _ in range(1500)]), fit_every=1).filter("held_out").collect()
    words = sum(r.n_tokens for r in got)
    model, base = sum(r.score for r in got) / words, sum(r.base_score for r in got) / words
    assert len(got) > 80 and model > base + 0.3, (model, base)


def test_lm_learns_from_all_training_texts(spark, monkeypatch):
    seen = {}
    for name in ("_counted_neighbours", "_averaged"):
        inner = getattr(lm_scoring, name)
        monkeypatch.setattr(lm_scoring, name, lambda texts, *a, name=name, inner=inner: (seen.update({name: {r.doc_id for r in texts.collect()}}), inner(texts, *a))[1])
    rng = random.Random(43)
    got = lm_scoring.lm_scores(docs_of(spark, [sentence(rng, 20) for _ in range(120)])).collect()
    training = {i for i in range(120) if fold(i, 10) != 0}
    assert seen == {"_counted_neighbours": training, "_averaged": training} and all(math.isfinite(r.score) for r in got)


def test_words_encoded_together_have_the_ids_of_each(monkeypatch):
    rng = random.Random(46)
    subwords = lm_scoring.Subwords(None)
    chars = "aeiou's'rnt019.,-_#@!\x00\x1c\x1f\x7f\xa0\u2003éßя中\U0001f600"
    words = ["".join(rng.choice(chars) for _ in range(rng.randint(1, 9))).encode() for _ in range(3000)] + [b"z" * 5000, b"\xff\xfe", b"'s", b"n't"]
    for some in (words, [w for w in words if w.isascii()], [w for w in words if not w.isascii()], words[:1], []):
        size, ids = subwords.encoded(some)
        got = np.split(ids, np.cumsum(size)[:-1]) if some else []
        assert [x.tolist() for x in got] == [subwords.encode(" " + w.decode("utf-8", "replace")) for w in some]
    # Where the lengths don't meet the words' ends, each is encoded by itself.
    subwords.bytes[:] = 7
    size, ids = subwords.encoded(words[:50])
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [subwords.encode(" " + w.decode("utf-8", "replace")) for w in words[:50]]


@pytest.mark.parametrize("first", [True, False])
def test_lm_slopes_against_differences(first):
    rng = np.random.default_rng(45)
    model = lm_scoring.Model(np.arange(30, dtype=np.int32) % 20, np.arange(30, dtype=np.int32) % lm_scoring.CLASSES)
    model.p = {k: rng.normal(0, 0.5, w.shape) for k, w in model.p.items()}
    x, y, live = rng.integers(0, 21, (5, lm_scoring.WINDOW)), rng.integers(0, lm_scoring.CLASSES, (5, lm_scoring.STRIDE)), rng.random((5, lm_scoring.STRIDE)) < 0.8

    def loss():
        p, total = model.p, 0.0
        for w in range(5):
            e = p["E"][x[w]]
            for i in range(lm_scoring.STRIDE):
                at = i + lm_scoring.WINDOW - lm_scoring.STRIDE
                seen = [j for j in range(at + 1) if not first or j >= lm_scoring.WINDOW - lm_scoring.STRIDE]
                a = np.array([e[at] @ p["Wq"] / 4 @ (e[j] @ p["Wk"]) + p["D"][at - j] for j in seen])
                a = np.exp(a) / np.exp(a).sum()
                z = np.tanh(a @ (e[seen] @ p["Wv"]) + e[at] @ p["Wr"]) @ p["Wc"] + p["bc"]
                total += live[w, i] * (np.log(np.exp(z).sum()) - z[y[w, i]])
        return total / live.sum()

    got = model.slopes(x, first, y, live, most=2)
    for name, w in model.p.items():
        for _ in range(3):
            k = tuple(rng.integers(0, n) for n in w.shape)
            was = w[k]
            w[k] = was + 1e-4
            more = loss()
            w[k] = was - 1e-4
            less = loss()
            w[k] = was
            assert got[name][k] == pytest.approx((more - less) / 2e-4, rel=1e-3, abs=2e-6), name


NAMES = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work".split()


def test_attention_matches_plain_loops_and_sums_to_one():
    rng = np.random.default_rng(0)
    size = 120
    stream = rng.integers(0, size, 300).astype(np.int32)
    n = np.bincount(stream, minlength=size)
    model = lm_scoring.Model(*lm_scoring.classes(n, lm_scoring.neighbours(stream, *lm_scoring.leads(n))))
    model.set_counts(n)
    cut = np.array([0, 1, 30, 300])
    model.fit(stream, cut)
    got, p = model.score(stream, cut), model.p

    def log_p(text):
        total = 0.0
        for begin in range(0, len(text), lm_scoring.STRIDE):
            for i in range(begin, min(begin + lm_scoring.STRIDE, len(text))):
                seen = range(max(0, begin - 8), i + 1)
                e = {j: p["E"][model.begin if j == 0 else model.row[text[j - 1]]] for j in seen}
                a = np.array([e[i] @ p["Wq"] / 4 @ (e[j] @ p["Wk"]) + p["D"][i - j] for j in seen])
                a = np.exp(a - a.max())
                h = np.tanh(sum(x * (e[j] @ p["Wv"]) for x, j in zip(a / a.sum(), seen)) + e[i] @ p["Wr"])
                z = h @ p["Wc"] + p["bc"]
                total += z[model.klass[text[i]]] - np.log(np.exp(z).sum()) + model.given[text[i]]
        return total / math.log(10)

    for k in range(3):
        assert got[k] == pytest.approx(log_p(stream[cut[k] : cut[k + 1]]), rel=1e-4)
    for c in set(model.klass.tolist()):
        assert np.exp(model.given[model.klass == c]).sum() == pytest.approx(1, rel=1e-4)


def brute_leaks(texts, items):
    words = lambda t: re.findall(r"[0-9a-z]+", (t or "").lower())
    out = set()
    for (i, t), (k, item) in itertools.product(enumerate(texts), items):
        own = words(item)
        grams = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        if own and len(grams(own) & grams(words(t))) >= 0.9 * len(grams(own)):
            out.add((i, k))
    return out


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(k, sentence(rng, rng.randint(15, 50)) + ". " + sentence(rng, 8) + ".") for k in range(60)]
    texts = []
    for i in range(120):
        words = sentence(rng, rng.randint(5, 400)).split()
        if i % 4 == 0:
            at = rng.randrange(len(words))
            words[at:at] = items[rng.randrange(60)][1].upper().split()
        texts.append(" ".join(words))
    texts += [None, "", items[7][1], items[8][1] + "\n" + sentence(rng, 20_000) + " " + items[9][1], texts[0]]
    table = spark.createDataFrame([*items, (None, "x y z"), (99, None), (98, ""), items[0]], "item_id long, text string")
    want = brute_leaks(texts, items)
    for shard in (1 << 24, 2_000):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, texts), table, shard_bytes=shard).collect()} == want
    assert {r.doc_id for r in decontaminate.decontaminate(docs_of(spark, texts), table).collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert decontaminate.contaminated(docs_of(spark, texts), table.limit(0)).count() == 0


def test_decontamination_of_long_items(spark):
    rng = random.Random(14)
    items = [(k, sentence(rng, n - 8, 10**6) + ". " + sentence(rng, 8, 10**6) + ".") for k, n in enumerate((20, 64, 65, 129, 300, 400, 1000, 1000))]
    texts = [sentence(rng, rng.randint(0, 700), 10**6) + " " + t + " " + sentence(rng, rng.randint(0, 700), 10**6) for _, t in items[:-1] for _ in range(3)]
    texts += [items[7][1][: len(items[7][1]) // 2], sentence(rng, 3000, 10**6), None]
    table = spark.createDataFrame(items, "item_id long, text string")
    for shard in (1 << 24, 3_000):
        got = decontaminate.contaminated(docs_of(spark, texts), table, shard_bytes=shard).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i // 3) for i in range(21)]
        assert all(r.question_overlap == r.answer_overlap == 1 and r.score == pytest.approx(1) for r in got)


def test_block_max_wand_finds_all_above_the_threshold():
    rng = random.Random(5)
    index = decontaminate.Index([(k, sentence(rng, rng.randint(3, 30), 60)) for k in range(90)])
    for _ in range(60):
        terms = np.array(sorted(rng.sample(range(len(index.terms)), rng.randint(1, 40))))
        score = Counter()
        for t in terms:
            for j in range(index.first[t], index.first[t + 1]):
                score[int(index.item[j])] += float(index.impact[j])
        for least in (0.1, 0.3, 0.5):
            got = dict(index.search(terms, least))
            assert got.keys() == {i for i, s in score.items() if s >= least}
            assert all(got[i] == pytest.approx(score[i]) for i in got)


def test_line_dedup_against_brute_force(spark, monkeypatch):
    """Every group that plain edit similarity of all pairs gives, on lines that share words and passages, by the shuffled joins."""
    monkeypatch.setattr(line_dedup, "BROADCAST_BLOCKS", 0)
    rng = random.Random(6)
    base = [sentence(rng, 40, 10**5) for _ in range(20)]
    passage = sentence(rng, 12, 10**5)
    lines = []
    for _ in range(140):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(40)] = f"n{rng.randrange(10**6)}q"
        lines.append("  ".join(words) if rng.random() < 0.2 else " ".join(words).capitalize())
    lines += [f"{sentence(rng, 15, 10**5)} {passage} {sentence(rng, 15, 10**5)}" for _ in range(40)]
    texts = ["\n".join([*lines[i : i + 4], "short line", ""]) for i in range(0, 180, 4)] + [None, "", "one\none", "w " * 30_000, lines[0]]
    rows = [(i, t, "en", "a", 0, 1, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[3], (None, lines[0], "en", "a", 0, 1, "x")], DOCS)
    occ = {(d, k): " ".join(x.lower().split()) for d, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if x.split()}
    at = {t: t for t in occ.values()}

    def top(t):
        while at[t] != t:
            t = at[t]
        return t

    for a, b in itertools.combinations(at, 2):
        if len(a.split()) >= 5 and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and top(a) != top(b) and plain_distance(a, b) <= 0.2 * max(len(a), len(b)):
            at[top(a)] = top(b)
    first = {}
    for p, t in sorted(occ.items()):
        first.setdefault(top(t), p)
    gone = {p for p, t in occ.items() if first[top(t)] != p}
    got = {(r.doc_id, k) for r in line_dedup.duplicates(df).collect() for k in r.dropped}
    assert got == gone and len(first) < len(at)
    out = line_dedup.dedup_lines(df).collect()
    assert len(out) == len(texts) + 2 and Counter(r.doc_id for r in out)[3] == 2
    for r in out:
        t = lines[0] if r.doc_id is None else texts[r.doc_id]
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (r.doc_id, k) not in gone)
        assert r.text == kept and r.n_dropped == sum(d == r.doc_id for d, _ in gone) and r.fp in ("clash", "x")
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    odd = line_dedup.dedup_lines(df.withColumnsRenamed({"fp": "gone_doc_id", "h": "gone_lines"}).withColumn("n_lines", F.lit("x")))
    assert {(r.doc_id, r.text, r.gone_doc_id) for r in odd.collect()} == {(r.doc_id, r.text, r.fp) for r in out}


def test_line_dedup_recall(spark):
    """At least nine tenths of random pairs at every share of changed words up to the least similarity, at every length."""
    rng = random.Random(26)
    pairs, kind = [], []
    for n in (5, 6, 8, 10, 12, 16, 20, 24, 32, 40, 50, 80, 200):
        for share in (0.02, 0.05, 0.1, 0.15, 0.2):
            for _ in range(12):
                a = [f"w{rng.randrange(10**4):04}" for _ in range(n)]
                b = list(a)
                for k in rng.sample(range(n), max(1, int(n * share))):
                    change = rng.random()
                    b[k] = f"q{rng.randrange(10**4):04}" if change < 0.6 else "" if change < 0.8 else b[k] + f" z{rng.randrange(100)}"
                a, b = " ".join(a), " ".join(" ".join(b).split())
                if a != b and plain_distance(a, b) <= 0.2 * max(len(a), len(b)):
                    pairs.append((a, b))
                    kind.append((n, share))
    gone = {r.doc_id for r in line_dedup.duplicates(docs_of(spark, [t for p in pairs for t in p])).collect()}
    found, all_ = Counter(), Counter()
    for i, k in enumerate(kind):
        for name in (k[0], k[1], "all"):
            all_[name] += 1
            found[name] += 2 * i + 1 in gone
    shares = {k: round(found[k] / all_[k], 2) for k in all_}
    assert gone <= {2 * i + 1 for i in range(len(pairs))} and shares["all"] >= 0.95 and min(shares.values()) >= 0.9, shares


def plain_distance(a, b):
    """Edit distance, a column of the table at a time, kept as bits of its steps."""
    where = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << max(0, len(a) - 1)
    up, down, d = full, 0, len(a)
    if not a:
        return len(b)
    for y in b:
        m = where.get(y, 0)
        zero = (((m & up) + up) ^ up) | m | down
        more, less = down | ~(zero | up) & full, up & zero
        d += (more & top > 0) - (less & top > 0)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(zero | more)) & full, more & zero & full
    return d


def test_line_dedup_finds_lines_by_edit_similarity_alone(spark):
    rng = random.Random(16)
    pairs = []
    for n in (5, 6, 7, 8, 9, 10, 12, 15, 20, 27, 40, 80):
        for share in (0.02, 0.1, 0.15):
            for _ in range(4):
                a = [f"w{rng.randrange(10**4):04}" for _ in range(n)]
                b = list(a)
                for k in rng.sample(range(n), max(1, int(n * share))):
                    b[k] = f"q{rng.randrange(10**4):04}"
                a, b = " ".join(a), " ".join(b)
                if plain_distance(a, b) <= 0.2 * max(len(a), len(b)):
                    pairs.append((a, b))
    got = {r.doc_id: r.dropped for r in line_dedup.duplicates(docs_of(spark, [t for p in pairs for t in p])).collect()}
    assert len(pairs) > 100 and set(got) <= {2 * i + 1 for i in range(len(pairs))} and len(got) >= 0.97 * len(pairs)


def crowded_block(n_pairs, seed=36):
    """Pairs of similar lines that share only the runs of words that all of the lines begin with, and the numbers of the lines that repeat others by plain edit similarity."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    lines = []
    for _ in range(n_pairs):
        last = word()
        lines += [f"received forwarded message subject {word()} {last}" for _ in range(2)]
    at = list(range(len(lines)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in itertools.combinations(at, 2):
        if plain_distance(lines[i], lines[j]) <= 0.2 * max(len(lines[i]), len(lines[j])):
            at[max(top(i), top(j))] = min(top(i), top(j))
    return lines, {i for i in range(len(lines)) if top(i) != i}


def test_line_dedup_compares_crowded_blocks_whole(spark):
    """Lines whose only common blocks hold very many lines, most of them unlike the block's least one."""
    lines, want = crowded_block(100)
    got = {r.doc_id: r.dropped for r in line_dedup.duplicates(docs_of(spark, lines)).collect()}
    assert 90 < len(want) < 150 and got == {i: [0] for i in want}


def test_pipeline_keeps_no_line_of_crowded_blocks_twice(spark):
    from acctlens.llm import pipeline

    lines, want = crowded_block(40, seed=37)
    out = {r.doc_id: (r.text, r.n_chars) for r in pipeline.line_deduplication(spark, docs_of(spark, lines), "").collect()}
    assert len(want) > 35 and out == {i: ("", 0) if i in want else (t, len(t)) for i, t in enumerate(lines)}


@pytest.mark.parametrize("whole", [6, 30])
def test_line_dedup_compares_very_large_blocks_by_rare_words(spark, monkeypatch, whole):
    """The same groups where blocks are too large for pairs of signatures, with lines that are mostly the words that all share."""
    monkeypatch.setattr(line_dedup, "WHOLE", whole)
    lines, want = crowded_block(60, seed=38)
    got = {r.doc_id: r.dropped for r in line_dedup.duplicates(docs_of(spark, lines)).collect()}
    assert len(want) > 50 and got == {i: [0] for i in want}


def test_lines_that_meet_in_words_of_large_blocks(spark):
    """Every two lines of a block with the least share of common words meet, few others do."""
    rng = random.Random(39)
    sets = {h: {1, 2, 3} | {rng.randrange(10, 60) for _ in range(rng.randint(0, 9))} for h in range(1, 120)}
    lines = spark.createDataFrame([(h, sorted(w)) for h, w in sets.items()], "h long, w array<long>")
    large = spark.createDataFrame([(7, h, 119) for h in sets], "key long, h long, size long")
    by_word = {}
    for r in line_dedup._met(large, lines).collect():
        by_word.setdefault(r.x, set()).add(r.h)
    met = {p for hs in by_word.values() for p in itertools.combinations(sorted(hs), 2)}
    need = {p for p in itertools.combinations(sorted(sets), 2) if len(sets[p[0]] & sets[p[1]]) >= 0.6 * max(len(sets[p[0]]), len(sets[p[1]]))}
    assert need and need <= met and not {1, 2, 3} & set(by_word)


def test_line_dedup_computes_what_bounds_by_words_leave(spark):
    """Long words of which four in twelve differ by a character: the bound by whole words is far over the distance allowed."""
    rng = random.Random(40)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(18))
    texts = []
    for _ in range(10):
        a = [word() for _ in range(12)]
        texts += [" ".join(a), " ".join(w[:9] + "0" + w[10:] + "s" * (k == 11) if k in (1, 5, 8, 11) else w for k, w in enumerate(a))]
    texts = spark.createDataFrame(list(enumerate(texts)), "h long, t string")
    near = spark.createDataFrame([(i, i + d) for i in range(0, 18, 2) for d in (1, 2)], "a long, b long")
    assert {(r.a, r.b) for r in line_dedup._verified(near, texts).collect()} == {(i, i + 1) for i in range(0, 18, 2)}


def test_line_dedup_leaves_no_shuffle_files_between_its_steps(spark, monkeypatch):
    """After each table of line dedup its shuffle files are gone, and the table of all blocks before documents are moved."""
    def shuffled():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for i in range(found.size()) if (f := found.apply(i).getName()).startswith("shuffle_")}

    before, left, files, alive = shuffled(), {}, [], []
    written = line_dedup.materialize

    def watched(df, label):
        if label == "lines-texts":
            alive.append(any(os.path.exists(f) for f in files))
        out = written(df, label)
        left[label] = shuffled() - before
        if label == "lines":
            files.extend("/" + f.removeprefix("file:").lstrip("/") for f in out.inputFiles())
        return out

    monkeypatch.setattr(line_dedup, "materialize", watched)
    lines, _ = crowded_block(30, seed=41)
    line_dedup.duplicates(docs_of(spark, lines))
    assert {"lines", "lines-distinct", "lines-shared", "lines-texts", "lines-rest"} <= set(left)
    assert not any(left.values())
    assert files and alive and not any(alive)


def test_line_dedup_takes_off_only_what_leaves_the_distance(spark):
    """Links of lines that begin or end alike, repeat words or are each other's beginning, against plain distances."""
    rng = random.Random(42)
    texts = [" ".join(rng.choice(("a", "a", "ab", "abc", "bcd")) for _ in range(rng.randint(5, 9))) for _ in range(60)]
    texts += ["a b c d e f g h", "a b c d e f g h h", "a b c d e f g", "b c d e f g h", "a b c d x e f g h"]
    rows = [(i, j, a, b) for (i, a), (j, b) in itertools.combinations(enumerate(dict.fromkeys(texts)), 2)]
    got = {(r.i, r.j) for r in spark.createDataFrame(rows, "i long, j long, t_a string, t_b string").filter(line_dedup._linked("t_a", "t_b")).collect()}
    words = lambda a, b: len({*a.split()} & {*b.split()}) >= 0.6 * max(len({*a.split()}), len({*b.split()}))
    assert got == {(i, j) for i, j, a, b in rows if words(a, b) and plain_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9} and len(got) > 10


def test_line_dedup_compares_no_pair_that_letters_or_groups_settle(spark, monkeypatch):
    """Lines with one passage after beginnings of one of two sets of letters: the same groups as by plain distances, from fewer pairs."""
    rng = random.Random(43)
    passage = " ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(10))
    begin = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(10)) for _ in range(3))
    lines = [f"{begin('abcde' if i % 2 else 'vwxyz')} {passage}" for i in range(60)]
    at = list(range(len(lines)))

    def top(at, i):
        while at[i] != i:
            i = at[i]
        return i

    for i, j in itertools.combinations(at, 2):
        if plain_distance(lines[i], lines[j]) <= 0.2 * max(len(lines[i]), len(lines[j])):
            at[max(top(at, i), top(at, j))] = min(top(at, i), top(at, j))
    calls = []
    verified = line_dedup._verified

    def watched(near, texts):
        out = verified(near, texts)
        calls.append(([(r.a, r.b) for r in near.collect()], [(r.a, r.b) for r in out.collect()]))
        return out

    monkeypatch.setattr(line_dedup, "_verified", watched)
    got = {r.doc_id: r.dropped for r in line_dedup.duplicates(docs_of(spark, lines)).collect()}
    assert got == {i: [0] for i in range(len(lines)) if top(at, i) != i} and 10 < len(got) < 58
    known = {h: h for pairs, _ in calls for p in pairs for h in p}
    for i, (pairs, links) in enumerate(calls):
        assert i == 0 or all(top(known, a) != top(known, b) for a, b in pairs)
        for a, b in links:
            known[max(top(known, a), top(known, b))] = min(top(known, a), top(known, b))
    # Pairs of one set of letters are 870 of 1770.
    assert len(calls) > 2 and sum(len(pairs) for pairs, _ in calls[1:]) <= 870


def test_line_dedup_of_short_lines(spark):
    texts = ["All rights reserved.\nHome\n\n \nhome page", "ALL  rights reserved.\n\n \nhome  Home\nHome", "all rights reserved", None]
    out = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert out == {0: (texts[0], 0), 1: ("\n \nhome  Home", 2), 2: (texts[2], 0), 3: (None, 0)}


def test_mixing(spark):
    rng = random.Random(7)
    texts = [sentence(rng, rng.randint(1, 30)) for _ in range(600)] + [None, ""]
    sources = ["big"] * 6 + ["mid"] * 2 + [None, "tiny"]
    df = docs_of(spark, texts, sources)
    rows = mixing.mix_sources(df, block_docs=16).collect()
    size = {i: len((t or "").split()) for i, t in enumerate(texts)}
    totals = Counter()
    for i in size:
        totals[sources[i % 10]] += size[i]
    budget = sum(totals.values())
    alpha = mixing.bisect_alpha(dict(totals), budget)
    weights = mixing.tempered(dict(totals), alpha)
    assert mixing.entropy(weights) >= 0.95 * math.log(4) - 1e-9 and 0 <= alpha <= 1
    for s, w in weights.items():
        own = [r for r in rows if r.source == s]
        used, most = sum(r.tokens for r in own), max(size.values())
        assert w * budget <= used + 1e-6 < w * budget + most + 1
        epochs = Counter(r.doc_id for r in own)
        assert max(epochs.values()) - min([epochs[i] for i in size if sources[i % 10] == s and size[i]]) <= 1
        places = sorted(r.place for r in own)
        assert len(set(places)) == len(places) and places[0] == 0 and places[-1] < 1
        order = sorted(own, key=lambda r: r.place)
        assert all(round((b.place - a.place) * w * budget, 3) == a.tokens for a, b in zip(order, order[1:]))
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert mixing.bisect_alpha({"a": 900, "b": 10}, 910, share=None, repeats=3.0) < 1 and mixing.bisect_alpha({"a": 5}, 5) == 1.0


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(8)
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    pages = [(i, f"http://x/{i}\r\n", "".join(rng.choice("abcé<>\r\n") for _ in range(rng.randint(0, 3000)))) for i in range(60)]
    same, big = "s" * 1000, "WARC/1.1\r\n" + fake * 40 + "x" * 3000 + "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n"
    pages += [(100 + i, None, same) for i in range(5)] + [(200 + i, "u", "t" * 999) for i in range(3)] + [(300, "u", big), (301, "u", big), (302, "u", fake), (303, "u", None), (304, "u", ""), (305, "u", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, size long").repartition(3)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        warc.write_warc(df, f"file://{tmp_path}/w")
        got = {r.page_id: r for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    import hashlib

    assert got.keys() == {p[0] for p in pages}
    last = {h: i for i, _, h in sorted(pages, key=lambda p: p[0]) if h and len(h.encode()) >= 1000}
    for i, _, h in pages:
        body = (h or "").encode()
        r, keeper = got[i], last.get(h, i)
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", keeper) if keeper != i else ("response", None))
    assert len(list(tmp_path.glob("w/part-*"))) == 3


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as script

    from acctlens.llm import pipeline as corpus_pipeline

    assert script.STAGES is corpus_pipeline.STAGES and script.run is corpus_pipeline.run and script.ORACLE_SQL is None
    rng = random.Random(9)
    items = [(k, sentence(rng, 30) + ". " + sentence(rng, 8) + ".") for k in range(5)]
    good = ["\n".join(sentence(rng, 15, 3000) + "." for _ in range(4)) for _ in range(60)]
    texts = good + [sentence(rng, 40, 3000).upper() + "!!" for _ in range(40)] + [good[0], good[1] + "\nlast words", sentence(rng, 30, 3000) + " " + items[2][1]]
    path = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", "abc"[i % 3], len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(not 60 <= i < 100)) for i in range(103)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    kept = corpus_pipeline.quality_classifier(spark, docs, path)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(103) if not 60 <= i < 100}
    lined = corpus_pipeline.line_deduplication(spark, kept, path)
    by_id = {r.doc_id: r.text for r in lined.collect()}
    assert by_id[100] == "" and by_id[101] == "last words" and all(by_id[i] == good[i] for i in range(60))
    unique = corpus_pipeline.simhash_near_dedup(spark, kept, path)
    ids = {r.doc_id for r in unique.collect()}
    assert 0 in ids and 100 not in ids and set(range(60)) <= ids
    clean = corpus_pipeline.benchmark_decontamination(spark, kept, path)
    assert {r.doc_id for r in clean.collect()} == {i for i in range(102) if not 60 <= i < 100}
    out = corpus_pipeline.run(spark, path).collect()
    assert out and {r.doc_id for r in out} <= set(range(60)) | {101}
