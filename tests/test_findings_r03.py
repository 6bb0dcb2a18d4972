"""Tests of the third round's findings."""

import itertools
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from acctlens.functions import codes
from acctlens.functions import text as X
from acctlens.functions import vectors as V
from acctlens.operators import chronobiology as K
from acctlens.operators import evaluate as E
from acctlens.operators import semantic as S
from acctlens.operators import stylometry as Y
from acctlens.plans import catalogue2


def test_rhythm_is_no_expression_within_loops(spark):
    """Of many accounts only the trough is asked for, which is when the optimizer put the bins into the loops over them."""
    e = spark.range(40_000).select((F.col("id") % 2000).cast("string").alias("account_id"), (F.col("id") * 977.0).alias("t"))
    trough = K.rhythm(K.smoothed(e)).select("account_id", "trough_cos", "trough_sin", "trough_mass")
    assert "lambda" not in trough._jdf.queryExecution().optimizedPlan().toString()
    got = {r.account_id: r for r in trough.collect()}
    assert len(got) == 2000
    for a in (0, 1, 777):
        counts = [0] * 48
        for i in range(a, 40_000, 2000):
            counts[int(i * 977.0 % 86400 // 1800)] += 1
        raw = [sum(n * math.exp(-0.5 * min(abs(i - j), 48 - abs(i - j)) ** 2) for j, n in enumerate(counts)) for i in range(48)]
        mass = [sum(raw[(s + o) % 48] for o in range(12)) / sum(raw) for s in range(48)]
        low = min(range(48), key=lambda s: (round(mass[s], 12), s))
        angle = 2 * math.pi * ((low + 6) % 48) / 48
        assert (got[str(a)].trough_cos, got[str(a)].trough_sin, got[str(a)].trough_mass) == pytest.approx((math.cos(angle), math.sin(angle), mass[low]), abs=1e-12)


def test_equal_values_have_no_spread(spark):
    """Partial moments of equal values, merged from parts of such sizes, left a spread of rounding errors."""
    value, rng = math.log1p(1800.0), random.Random(4)
    size = next(n for n in range(2, 500) if value / n * n != value)
    rows = [(str(i), 0, value) for i in range(3 * size)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "account_id string, idx int, value double")
    df = df.union(spark.createDataFrame([(str(i), 1, rng.random()) for i in range(9)], df.schema))
    stats = {r.idx: r.std for r in K.fit(df).collect()}
    assert stats[0] == 0 and stats[1] > 0.1
    assert {r.w for r in K.vectors(df.filter("idx = 0"), K.fit(df)).collect()} == {0.0}


def test_calibration_computes_its_cosines_once(spark, monkeypatch):
    """Each reading of the cosines gave them a new last bit here; values that are compared must be the same ones."""
    rows = spark.createDataFrame([(str(i), str(i + 2 - i % 3 % 2)) for i in range(200)], "a string, b string")
    monkeypatch.setattr(catalogue2, "_cosines", lambda spark, d: rows.withColumn("cosine", F.expr("0.9 * (java_method('java.lang.Math', 'random'))")))
    got = catalogue2.calibrate_percentile(spark, "").collect()
    assert len(got) == 200 and all(r.percentile is not None for r in got)


ODD = ["Où  est?? la gareee  ", "wait.... no…… (🎲)", "ABC ǅ ｘｘｘ --", "Straße ΣΟΦΟΣ İx THE the Strasse", "", None, "a", "ab", "\U00020000\U00020001the\U00020000", "x" * 50 + "!!!...?!", "den strassen σοφοσ ﬁn fin"]


def odd_messages(spark):
    from test_engine import MESSAGES

    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", "c", None]), f"m{i}", "g", "c", i, rng.choice(ODD), False, "s", i) for i in range(300)]
    return spark.createDataFrame([*rows, ("none", "n", "g", "c", 0, None, False, "s", 1)], MESSAGES), rows


def test_grams_are_added_up_in_their_task(spark, monkeypatch):
    """The counts of an account are those of its messages' grams, and far fewer rows leave Python than those have."""
    m, _ = odd_messages(spark)
    for got, plain, dim in ((Y.account_hashed_grams(m), X.hashed_grams(m), "bucket"), (Y.account_plain_grams(m), Y.plain_grams(m), "gram")):
        want = Y.account_grams(plain, dim)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    texts = pa.RecordBatch.from_arrays([pa.array(["a", "b"] * 2000), pa.array(["the same words again"] * 4000)], names=["account_id", "text"])
    emit = lambda accounts, a, g, n, df: pa.RecordBatch.from_arrays([pa.array(a), pa.array(g), pa.array(n), pa.array(df)], names=["a", "g", "n", "df"])
    numbers: dict = {}
    for held in (codes.HELD, 8):
        monkeypatch.setattr(codes, "HELD", held)
        out = pa.Table.from_batches(list(codes.account_gram_counts([texts] * 3, (2,), lambda g: numbers.setdefault(g, len(numbers)), emit))).to_pandas()
        total = out.groupby(["a", "g"])[["n", "df"]].sum()
        assert len(total) == 2 * 18 and set(total.df) == {6000} and total.n.sum() == 19 * 12000
        assert held == 8 or len(out) == len(total)


def test_grams_are_numbered_alike_with_and_without_tables(monkeypatch):
    rng = random.Random(3)
    texts = pa.array(["".join(chr(rng.choice([rng.randrange(97, 123), rng.randrange(0x4E00, 0x5000), 0x20000])) for _ in range(rng.randrange(60))) for _ in range(200)])
    whole, points, at = codes.code_points(texts)
    want = {n: [(t, "".join(g)) for t, s in enumerate(texts.to_pylist()) for g in zip(*(s[k:] for k in range(n)))] for n in (2, 3, 4)}
    for cells in (codes.CELLS, 1 << 17, 1):
        monkeypatch.setattr(codes, "CELLS", cells)
        names: dict = {}
        grams = codes.Grams((2, 3, 4), lambda g: names.setdefault(g, len(names)))
        for _ in range(5):
            found = grams(whole, points, at)
            listed = list(names)
            for n, (place, number) in zip((2, 3, 4), found):
                assert [(int(t), listed[k]) for t, k in zip(np.searchsorted(at, place, "right") - 1, number)] == want[n]


def test_marks_and_words_of_odd_texts(spark):
    m, rows = odd_messages(spark)
    stats = {(r.account_id, r.idx): r.value for r in Y.structural(m).collect()}
    words = {(r.account_id, r.word): r.freq for r in Y.function_words(m, ["the", "strasse", "σοφοσ", "i̇x", "fin"]).collect()}
    assert stats["none", 37] is None and ("none", "the") not in words
    for a in ("a", "b", "c", None):
        own = [r[5] for r in rows if r[0] == a]
        texts = [t for t in own if t is not None]
        whole, tokens = sum(map(len, texts)), [w for t in texts for w in X.casefolded_tokens(t)]
        runs = [(c, len(list(g))) for t in texts for c, g in itertools.groupby(t)]
        assert stats[a, 0] == pytest.approx(sum(n - 1 for c, n in runs if c == " ") / whole)
        assert stats[a, 33] == pytest.approx(sum(n if c == "…" else 1 for c, n in runs if c == "…" or n > 1 and c in X.PUNCTUATION) / whole)
        assert stats[a, 35] == pytest.approx(sum(1 for c, n in runs if n > 2 and c.isalpha()) / whole)
        assert stats[a, 34] == pytest.approx(sum(c.isupper() for t in texts for c in t) / sum(c.isalpha() for t in texts for c in t))
        assert stats[a, 37] == pytest.approx(whole / len(own))
        for i, c in enumerate(X.PUNCTUATION, 1):
            assert stats[a, i] == pytest.approx(sum(t.count(c) for t in texts) / whole)
        for w in ("the", "strasse", "σοφοσ", "i̇x", "fin"):
            assert words[a, w] == pytest.approx(tokens.count(w) / len(tokens)), w


def test_bootstrap_follows_the_generator_and_is_fast(spark):
    rng = random.Random(6)
    for size in (1, 5, 64, 1000):
        same = random.Random(11)
        for drawn in E.draws(11, size, 7, chunk=50):
            assert drawn.tolist() == [same.choice(range(size)) for _ in range(size)]
    rows = [(float(rng.randint(0, 30)), rng.random() < 0.3) for _ in range(150)]
    df = spark.createDataFrame(rows, "score double, is_same boolean")
    got = {r.metric: (r.low, r.high) for r in E.bootstrap(df, 12.0, n=100).collect()}
    for i, metric in enumerate(("roc_auc", "precision", "recall")):
        own, generator = sorted(rows), random.Random(1729 + i)
        samples = [[generator.choice(own) for _ in own] for _ in range(100)]
        values = sorted(E._auc(s) if metric == "roc_auc" else E._rate(s, 12.0, metric) for s in samples)
        assert got[metric] == (values[2], values[96])
    many = spark.range(20_000).select((F.col("id") * 37 % 1001 / 10).alias("score"), (F.col("id") * 11 % 7 < 3).alias("is_same"))
    begun = time.time()
    assert E.bootstrap(many, 20.0).count() == 3
    assert time.time() - begun < 20  # 20,000,000 draws for each metric, over a minute one by one


def test_batches_are_cut_by_the_size_of_their_texts(spark, monkeypatch):
    """Python holds a part of a batch, whatever the batch's texts come to; and no row is lost."""

    class Sized(S.SyntheticModel):  # within the test, so that it is sent along
        def embed(self, texts):
            assert sum(map(len, texts)) <= 1 << 18
            return S.SyntheticModel.embed(self, texts)

    texts = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.concat(F.repeat(F.lit("some word 12 "), 100), "id").alias("text")).coalesce(1)
    masked = X.mask_exact(texts)
    sizes = masked.select("id", F.length("masked").alias("n"))
    assert sizes.count() == 3000 and sizes.agg(F.min("n"), F.max("n")).first()[0] > 1000
    rows = S.window_rows(texts, catalogue2.VOCAB, 64)
    assert rows.groupBy("id").agg(F.sum(F.length("text")).alias("n")).join(texts, "id").filter("n = length(text)").count() == 3000
    vectors, _ = S.embed(rows, Sized())
    assert vectors.count() == rows.select("key").distinct().count()
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "", "y" * 90, "z" * 200, "w"])], names=["t"])
    assert [p.column(0).to_pylist() for p in codes.parts(batch, 0, 100)] == [["x" * 10, None, "", "y" * 90], ["z" * 200], ["w"]]


def test_pair_cosines_shuffle_a_vector_as_one_row(spark):
    """Against plain sums, with dimensions that one side lacks, zeros, accounts without a vector, and parts of any size."""
    rng = random.Random(7)
    vectors = {f"v{i}": {k: rng.choice([0.0, rng.uniform(-0.2, 0.2)]) for k in rng.sample(range(0, 400_000, 977), rng.randrange(1, 60))} for i in range(40)}
    rows = spark.createDataFrame([(a, k, w) for a, v in vectors.items() for k, w in v.items()], "account_id string, idx long, w double")
    listed = [(a, b) for a in [*vectors, "none"] for b in ["v0", "v7", "v39", "nobody"]]
    got = V.pair_cosine(spark.createDataFrame(listed, "a string, b string"), rows)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    found = {(r.a, r.b): r.cosine for r in got.collect()}
    assert len(found) == len(listed)
    for a, b in listed:
        want = sum(w * vectors.get(b, {}).get(k, 0.0) for k, w in vectors.get(a, {}).items())
        assert found[a, b] == pytest.approx(max(-1.0, min(1.0, want)), abs=1e-12)
    lists = pa.RecordBatch.from_arrays([pa.array([[1, 2], [3], None, [4, 5, 6]])], names=["l"])
    assert [p.num_rows for p in V.parts(lists, 0, 3)] == [3, 1]


def test_shortlist_computes_each_engines_cosines_once(spark, monkeypatch):
    calls = []
    vectors = spark.createDataFrame([(str(i), k, w) for i in range(9) for k, w in ((0, 0.6), (1, 0.8 - i / 20))], "account_id string, idx int, w double")
    pairs = spark.createDataFrame([(str(i), str(j)) for i in range(9) for j in range(i)], "a string, b string")
    profiles = spark.createDataFrame([(str(i), "READY", 99, 999) for i in range(9)], "account_id string, status string, n_messages long, n_chars long")
    cosine = V.pair_cosine
    monkeypatch.setattr(catalogue2.V, "pair_cosine", lambda *a: calls.append(1) or cosine(*a))
    monkeypatch.setattr(catalogue2.cmp, "pair_cosine", lambda *a: calls.append(1) or cosine(*a))
    monkeypatch.setattr(catalogue2, "_pair_list", lambda spark, d: pairs)
    monkeypatch.setattr(catalogue2, "_ev", lambda spark, d: None)
    monkeypatch.setattr(catalogue2.P, "profiles", lambda *a: profiles)
    monkeypatch.setattr(catalogue2, "_engine_vectors", lambda spark, d: dict.fromkeys(("stylometry", "semantic", "chronobiology"), vectors))
    rows = catalogue2.shortlist(spark, "").collect()
    assert len(calls) == 3 and len(rows) == 36 and all(r.status == "OK" for r in rows)
    least = [r for r in rows if (int(r.a) + int(r.b)) % 2 == 0]
    assert max(r.semantic_percentile for r in least) == 100 and min(r.semantic_percentile for r in least) > 0


def test_texts_that_come_again_are_cut_once(spark):
    texts = spark.range(6000).select("id", F.when(F.col("id") % 500 == 7, F.lit(None)).otherwise(F.concat(F.lit("the word "), F.col("id") % 40, F.lit(" Ends"))).alias("text")).coalesce(1)
    got = S.window_rows(texts, catalogue2.VOCAB, 8).select("id", "window", "text", "ids").collect()
    rows = {(int(r.id), r.window): (r.text, r.ids) for r in got}
    want = {(t.id, k): w for t in texts.collect() for k, w in enumerate(S.windows(t.text or "", catalogue2.VOCAB, 8))}
    assert rows == want and len(got) == len(want)


def test_pair_cosines_of_dimensions_that_are_texts(spark):
    rows = spark.createDataFrame([("a", "\nD", 0.6), ("a", "z", 0.8), ("b", "z", 0.5), ("b", "\nD", 0.5), ("b", "😀", 0.1)], "account_id string, idx string, w double")
    assert V.pair_cosine(spark.createDataFrame([("a", "b")], "a string, b string"), rows).first().cosine == pytest.approx(0.7)
