"""Odd batches, nulls, repeated rows and clashing names, and training steps against plain loops."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from acctlens.llm import _common, decontaminate, mixing, pipeline, quality, toxicity, warc

from test_learned_and_joined import docs_of, sentence


def test_batches_of_any_number_of_rows():
    for texts in ([None], [b""], [b"one"], [b"a", None], [b"x" * 9] * 10_001):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], names=["i", "t"])
        got = list(_common.slices(batch, 1000))
        assert [x for b in got for x in b.column(0).to_pylist()] == list(range(len(texts)))
        assert all(b.num_rows == 1 or sum(len(t or b"") for t in b.column(1).to_pylist()) <= 1000 for b in got)


@pytest.mark.parametrize("n", [1, 2, 10_001])
def test_scores_of_partitions_of_any_number_of_rows(spark, n):
    docs = spark.range(n).coalesce(1).select(F.col("id").alias("doc_id"), F.when(F.col("id") > 0, F.lit("some words here")).alias("text"))
    weights = (np.zeros(1 << toxicity.BITS, np.float32), -1.0)
    assert toxicity.score(docs, weights).agg(F.count("score"), F.max("predicted")).first()[:] == (n, 0)
    assert quality.score(docs, (np.zeros(1 << quality.BITS, np.float32), -1.0)).count() == n
    items = spark.createDataFrame([(1, "some words here")], "item_id long, text string")
    assert decontaminate.contaminated(docs, items).count() == n - 1


def test_slopes_of_the_risk_against_differences():
    rng = np.random.default_rng(1)
    rows, n, w, b = [np.array([0, 2], np.int32), np.zeros(0, np.int32), np.array([1], np.int32)], np.array([3, 1, 2]), rng.standard_normal(3), 0.3

    def loss(w, b):
        return sum(k * math.log1p(math.exp(b + sum(w[i] for i in r))) for r, k in zip(rows, n))

    g, gb, total = toxicity.slopes(rows, n, w, b)
    assert total == pytest.approx(loss(w, b))
    for i in range(3):
        e = np.eye(3)[i] * 1e-6
        assert g[i] == pytest.approx((loss(w + e, b) - loss(w - e, b)) / 2e-6, abs=1e-6)
    assert gb == pytest.approx((loss(w, b + 1e-6) - loss(w, b - 1e-6)) / 2e-6, abs=1e-6)


@pytest.mark.parametrize("unlabelled", [[(0, 9), (1, 1)], [(0, 1), (1, 9)]])
def test_refining_steps_against_plain_loops(spark, unlabelled):
    """The second case has too few toxic rows among the unlabelled for the prior, so that the risk's estimate is negative and its step is reversed."""
    slots = [np.array([0], np.int32), np.zeros(0, np.int32)]
    table = spark.createDataFrame([(bytearray(slots[k].tobytes()), n) for k, n in unlabelled], "slots binary, n long")
    w, b = toxicity.refine([slots[0]] * 4, table, np.array([2.0]), -1.0, 0.5, steps=3, rate=0.1)
    x, m, v = np.array([2.0, -1.0]), np.zeros(2), np.zeros(2)
    s, soft, total = lambda z: 1 / (1 + math.exp(-z)), lambda z: math.log1p(math.exp(z)), sum(n for _, n in unlabelled)
    signs = set()
    for t in range(1, 4):
        z = {0: x[0] + x[1], 1: x[1]}
        at = {0: np.array([1.0, 1.0]), 1: np.array([0.0, 1.0])}
        negative = sum(n * soft(z[k]) for k, n in unlabelled) / total - 0.5 * soft(z[0])
        down = sum(n * s(z[k]) * at[k] for k, n in unlabelled) / total - 0.5 * s(z[0]) * at[0]
        signs.add(negative >= 0)
        grad = 0.5 * (s(z[0]) - 1) * at[0] + down if negative >= 0 else -down
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        x = x - 0.1 * (1 - (t - 1) / 3) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    assert (w[0], b) == pytest.approx(tuple(x)) and signs == {unlabelled[0][1] == 9}


def test_quality_training_against_plain_loops():
    examples = [(np.array([3, 9], np.int32), np.array([2, 1], np.int32), 1), (np.array([9], np.int32), np.array([1], np.int32), 0)]
    odds, bias = quality.train(examples, epochs=2, lr=0.5, seed=4)
    rng = np.random.default_rng(4)
    e = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (1 << quality.BITS, quality.DIM)).astype(np.float32).astype(float)
    w, b, done = np.zeros((quality.DIM, 2)), np.log([0.5, 0.5]), 0
    for _ in range(2):
        for k in rng.permutation(2):
            at, n, y = examples[k]
            rate, share = 0.5 * (1 - done / 4), n / n.sum()
            done += 1
            mean = sum(f * e[i] for f, i in zip(share, at))
            z = [sum(mean[d] * w[d, c] for d in range(quality.DIM)) + b[c] for c in (0, 1)]
            p = np.array([math.exp(x) for x in z]) / sum(math.exp(x) for x in z) - np.eye(2)[y]
            back = w @ p
            w, b = w - rate * np.outer(mean, p), b - 0.1 * rate * p
            for f, i in zip(share, at):
                e[i] = e[i] - rate * len(at) ** 0.5 * f * back
    assert bias == pytest.approx(b[1] - b[0], abs=1e-5)
    assert [odds[3], odds[9]] == pytest.approx([e[i] @ (w[:, 1] - w[:, 0]) for i in (3, 9)], abs=1e-5)


def test_mixing_places_against_a_walk(spark):
    """Each source's uses, put in order, are whole epochs of all its rows, and every block of an epoch is a run of places; one row is repeated very often."""
    rows = [(i, "w " * (1 + i % 5), "en", "ab"[i % 3 == 0], 0, 1, "x") for i in range(90)] + [(7, "w w", "en", "a", 0, 1, "x")] * 200 + [(None, "w", "en", "b", 0, 1, "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copies long, block long, tokens string")
    out = mixing.mix_sources(docs, budget=3000, block_docs=8, share=None, repeats=None)
    sizes = defaultdict(Counter)
    for i, t, _, s, *_ in rows:
        sizes[s][i, len(t.split())] += 1
    for s, own in sizes.items():
        got = sorted((r for r in out.collect() if r.source == s), key=lambda r: r.place)
        quota, at = got[0].weight * 3000, 0
        for r in got:
            assert round(r.place * quota) == at
            at += r.tokens
        assert quota <= at < quota + 6
        for epoch in range(got[-1].epoch):
            assert Counter((r.doc_id, r.tokens) for r in got if r.epoch == epoch) == own
        blocks = [(r.epoch, r.block) for r in got]
        assert len([1 for x, y in zip(blocks, blocks[1:]) if x != y]) + 1 == len(set(blocks))
        assert max(Counter(r.block for r in got if r.epoch == 0).values()) < 60
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_question_without_its_answer_is_no_leak(spark):
    rng = random.Random(3)
    question, answer = sentence(rng, 40, 10**5), sentence(rng, 9, 10**5)
    items = spark.createDataFrame([(1, f"{question}. {answer}."), (2, sentence(rng, 30, 10**5) + ".")], "item_id long, text string")
    docs = docs_of(spark, [question, f"x {question}. {answer}. y", answer]).withColumnRenamed("fp", "contaminated_id")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 1)]
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 2}


def test_scores_do_not_depend_on_shards(spark):
    rng = random.Random(6)
    items = spark.createDataFrame([(k, sentence(rng, 25, 90) + ". " + sentence(rng, 6, 90) + ".") for k in range(40)], "item_id long, text string")
    docs = docs_of(spark, [sentence(rng, 20, 90) + " " + r.text for r in items.collect()])
    rows = [sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.contaminated(docs, items, shard_bytes=b).collect()) for b in (1 << 24, 1500)]
    assert rows[0] == rows[1] and len(rows[0]) >= 40


def test_archives_may_be_split_otherwise_between_reads(spark, tmp_path, monkeypatch):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:5>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    pages = [(-i, "u", (fake * (i % 4) + "é" * i * 40)) for i in range(1, 60)] + [(None, "u", "z" * 2000), (-1000, None, "t" * 1500), (-999, None, "t" * 1500), (7, "u", None)] + [(8, "u", "r" * 1200)] * 2
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    old, seen = spark.conf.get("spark.sql.files.maxPartitionBytes"), []

    def otherwise(table, label, write=warc.materialize):
        out = write(table, label)
        seen.append(label)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(2000 + 777 * len(seen)))
        return out

    try:
        warc.write_warc(df, f"file://{tmp_path}/w")
        monkeypatch.setattr(warc, "materialize", otherwise)
        got = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    import hashlib

    want = Counter((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in pages)
    assert "warc-wanted" in seen and Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    assert {r.page_id: r.refers_to for r in got if r.record_type == "revisit"} == {-1000: -999}
    assert warc.read_warc(spark, _empty(spark, df, tmp_path)).count() == 0


def _empty(spark, df, tmp_path):
    warc.write_warc(df.limit(0), f"file://{tmp_path}/none")
    return f"file://{tmp_path}/none"


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    rng = random.Random(8)
    spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, sentence(rng, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = sentence(rng, 30_000)
    rows = [(0, "a fine text here", "en", "s", 4, "x"), (0, "a fine text here", "en", "s", 4, "x"), (None, "a fine text here", None, None, None, "x"), (3, None, "en", "s", 0, "x"), (4, "", "en", "s", 0, "x"), (5, long, "en", "t", 9, "x"), (6, long, "en", "t", 9, "x")]
    names = "doc_id long, text string, lang string, source string, n_chars long, found_id string"
    docs = spark.createDataFrame(rows, names)
    columns = list(pipeline.COLUMNS)
    for name, stage in pipeline.STAGES:
        out, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0
        if name != "source mixing":
            assert out.columns == none.columns == columns
        got = [r.doc_id for r in out.collect()]
        if name == "SimHash near-dedup":
            assert sorted(x for x in got if x is not None) == [0, 3, 5] and got.count(None) == 1
        elif name == "source mixing":
            assert set(got) == {0, None, 5, 6}
        elif name == "line dedup":
            texts = [(r.doc_id, r.text) for r in out.collect()]
            assert Counter(texts) == Counter([(0, rows[0][1])] * 2 + [(None, rows[0][1]), (3, None), (4, ""), (5, long), (6, "")])
        else:
            assert Counter(got) == Counter(r[0] for r in rows) or name == "quality classifier"
    assert pipeline.STAGES[2][1](spark, docs.select("doc_id", "text"), str(tmp_path)).columns == columns


def test_quality_of_a_text_is_the_same_in_any_slice():
    texts = [b"alpha beta, gamma.", b"delta", None, b"x y zz " * 40, b"alpha beta, gamma."]
    odds = np.random.default_rng(0).standard_normal(1 << quality.BITS).astype(np.float32)
    whole = quality.scores(texts, odds, 0.1)
    assert np.allclose(whole, np.concatenate([quality.scores([t], odds, 0.1) for t in texts]), atol=1e-12) and whole[0] == pytest.approx(whole[4], abs=1e-12)
    for (a, n), (b, m) in zip(quality.counted(texts), [quality.counted([t])[0] for t in texts]):
        assert np.array_equal(a, b) and np.array_equal(n, m)
