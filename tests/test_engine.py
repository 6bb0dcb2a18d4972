"""Golden values of the engine's operators, as small DataFrames."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from acctlens.functions import text as X
from acctlens.operators import baselines as B
from acctlens.operators import calibration as C
from acctlens.operators import chronobiology as K
from acctlens.operators import evaluate as E
from acctlens.operators import prep as P
from acctlens.operators import semantic as S
from acctlens.operators import stylometry as Y
from acctlens.schemas import ContractError, IngestSettings
from acctlens.sources import chatlog

MESSAGES = "account_id string, message_id string, game_id string, channel_id string, us long, text string, is_system boolean, source_id string, source_row long"


def messages(spark, rows):
    return spark.createDataFrame([("a", f"m{i:03}", "g", "c", int(t * 1e6), x, False, "s", i + 1) for i, (t, x) in enumerate(rows)], MESSAGES)


def test_sessions_start_at_a_gap_equal_to_the_limit(spark):
    m = messages(spark, [(0, "x"), (29 * 60, "x"), (59 * 60, "x"), (60 * 60, "x")])
    assert [r.session for r in P.sessions(m).orderBy("seq").collect()] == [0, 0, 1, 1]
    only = P.sessions(P.hour_filter(m, [0]))
    assert only.count() == 3 and only.agg(F.max("session")).first()[0] == 1
    assert P.histogram24(m).first().activity[:2] == [3, 1]


def test_character_chunks_never_split_a_message(spark):
    m = messages(spark, [(0, "x" * 10), (1, "x"), (2, "x")])
    assert [r.chunk for r in P.chunks_by_chars(P.sessions(m), 5).orderBy("seq").collect()] == [0, 1, 1]
    rng = random.Random(1)
    sizes = [rng.randint(1, 30) for _ in range(200)]
    got = [r.chunk for r in P.chunks_by_chars(P.sessions(messages(spark, [(i, "y" * n) for i, n in enumerate(sizes)])), 40).orderBy("seq").collect()]
    want, chunk, filled = [], 0, 0
    for n in sizes:
        if filled and filled + n > 40:
            chunk, filled = chunk + 1, 0
        want.append(chunk)
        filled += n
        if filled >= 40:
            chunk, filled = chunk + 1, 0
    assert got == want


def test_features_of_one_event_and_of_a_uniform_day(spark):
    one = {r.idx: r.value for r in K.features(K.events(P.sessions(messages(spark, [(0, "xy")])))).collect()}
    assert len(one) == 122 and one[0] == 1 and one[1] == 0 and one[76] == pytest.approx(5.053299110804103e-15, rel=1e-3)
    day = {r.idx: r.value for r in K.features(K.events(P.sessions(messages(spark, [(1800 * i, "x") for i in range(48)])))).collect()}
    assert all(day[24 + i] == pytest.approx(1 / 48) for i in range(48)) and day[76] == pytest.approx(0.25)
    same = {r.idx: r.value for r in K.features(K.events(P.sessions(messages(spark, [(5, "x" * 2), (5, "x" * 3), (5, "x" * 5)])))).collect()}
    assert [same[i] for i in range(108, 112)] == pytest.approx([4, 1, 4, 4.8]) and same[102] == -1 and [same[i] for i in (96, 97, 98)] == [0, 0, 0]
    apart = {r.idx: r.value for r in K.features(K.events(P.sessions(messages(spark, [(0, "x"), (600, "x"), (1860, "x")]), 5))).collect()}
    assert apart[102] == pytest.approx((330 - 930) / (330 + 930)) and apart[117] == 1


def test_structural_values(spark):
    texts = ["Où  est?? la gareee  ", "wait.... no…… (🎲)", "ABC ǅ ｘｘｘ --"]
    whole = sum(map(len, texts))
    f = {r.idx: r.value for r in Y.structural(messages(spark, list(enumerate(texts)))).collect()}
    letters = [c for t in texts for c in t if c.isalpha()]
    assert f[0] == pytest.approx(sum(t[i : i + 2] == "  " for t in texts for i in range(len(t))) / whole)
    for i, c in enumerate(X.PUNCTUATION, 1):
        assert f[i] == pytest.approx(sum(t.count(c) for t in texts) / whole)
    # "??", "....", two ellipses and "--"; "eee" and the wide x; one die.
    assert f[33] == pytest.approx(5 / whole) and f[35] == pytest.approx(2 / whole) and f[36] == pytest.approx(1 / whole)
    assert f[34] == pytest.approx(sum(c.isupper() for c in letters) / len(letters)) and f[37] == pytest.approx(whole / 3)


def plain_mask(text, names, terms):
    """The masking chain, a character position at a time: the longest term that stands alone wins."""
    import re
    import unicodedata

    def replace(text, listed, at, to):
        out, i = "", 0
        while i < len(text):
            start = i + (at and text[i] == "@" and i + 1 < len(text))
            found = 0
            for w in listed:
                end = start + len(w)
                if text[start:end].lower() == w.lower() and end <= len(text) and not re.match(r"\w", text[end : end + 1] or " "):
                    found = max(found, end)
            before = text[i - 1] if i else " "
            alone = not re.match(r"[\w@]" if at else r"\w", before)
            out, i = (out + to, found) if found and alone else (out + text[i], i + 1)
        return out

    text = unicodedata.normalize("NFC", text)
    text = replace(text, names, True, "[USER]") if names else text
    text = re.sub(r"(?<!\w)@[\w.-]+", "[USER]", text)
    text = re.sub(r"\b(?:https?://|www\.)[^\s]+", "[URL]", text, flags=re.I)
    text = re.sub(r"(?<!\w)\d+(?:[.,]\d+)*(?!\w)", "[NUM]", text)
    text = replace(text, terms, False, "[GAME_TERM]") if terms else text
    return " ".join(text.split())


def test_masking(spark):
    names, terms = ["Zoë", "lag-king", "Lag"], ["fire", "Fire-Bolt", "fire bolt II"]
    rng = random.Random(5)
    bits = [*names, *terms, "@", "@zoë", "zoe\u0308", "x", "-", " ", "  ", "\t", "FIRE", "bolt", " ii", "3.5", "12,000", "v2", "www.a.b/c?d", "HTTPS://q", "@no.one", "."]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    mask = X.masker(names, terms)
    want = [plain_mask(t, names, terms) for t in texts]
    assert [mask(t) for t in texts] == want
    import unicodedata

    rows = spark.createDataFrame([(i, unicodedata.normalize("NFC", t)) for i, t in enumerate(texts)], "i int, text string")
    assert [r.m for r in rows.select("i", X.mask_sql(F.col("text"), names, terms).alias("m")).orderBy("i").collect()] == want


def test_hashed_grams_stay_in_messages(spark):
    got = {r.bucket for r in X.hashed_grams(messages(spark, [(0, "ab"), (1, "cd")]), seed=5).collect()}
    assert X.bucket("ab", X.gram_key(5), 262_144) in got and X.bucket("bc", X.gram_key(5), 262_144) not in got
    plain = {(r.message_id, r.gram): r.n for r in Y.plain_grams(messages(spark, [(0, "aaab"), (1, "x")]), 2).collect()}
    assert plain == {("m000", "aa"): 2, ("m000", "ab"): 1}


def test_windows_cover_the_text():
    vocab = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "a": 4, "b": 5, "c": 6}
    assert [s for s, _ in S.windows("a b c", vocab, 3)] == ["a ", "b ", "c"]


def test_percentiles_include_equal_values(spark):
    base = spark.createDataFrame([(x,) for x in (-1.0, -0.2, 0.1, 0.1, 1.0)], "cosine double")
    asked = spark.createDataFrame([(x,) for x in (-1.0, -0.5, 0.1, 0.5, 1.0, 1 + 5e-10, 2.0)], "cosine double")
    assert [r.percentile for r in C.percentile(base, asked).orderBy("cosine").collect()] == [20, 20, 80, 80, 100, 100, None]


def test_fusion_golden_and_all_statuses(spark):
    names = ("OK", "INSUFFICIENT_DATA", "TIMEOUT", "ERROR")
    error = {"OK": None, "INSUFFICIENT_DATA": "MINIMUMS_NOT_MET", "TIMEOUT": "ENGINE_TIMEOUT", "ERROR": "ENGINE_FAILURE"}
    rows = [(i, *[y for s, p in zip(st, (80.0, 20.0, 50.0)) for y in (s, p if s == "OK" else None, error[s])]) for i, st in enumerate(itertools.product(names, repeat=3))]
    shape = "id long, " + ", ".join(f"{e}_status string, {e}_percentile double, {e}_error string" for e in C.ENGINES)
    got = {r.id: r for r in C.fuse(spark.createDataFrame(rows, shape)).collect()}
    for i, st in enumerate(itertools.product(names, repeat=3)):
        want = "OK" if "OK" in st else "INSUFFICIENT_DATA" if set(st) == {"INSUFFICIENT_DATA"} else "TIMEOUT" if "TIMEOUT" in st else "ERROR"
        assert got[i].status == want and (got[i].combined_score is None) == (want != "OK")
    r = got[2]
    assert (r.weighted_percentile, r.fisher_tail_score, r.combined_score) == pytest.approx((52.0, 61.79428782333969, 56.89714391166984))


def test_metrics_against_plain_loops(spark):
    rng = random.Random(2)
    rows = [(float(rng.randint(0, 12)), rng.random() < 0.4) for _ in range(120)]
    df = spark.createDataFrame(rows, "score double, is_same boolean")
    assert E.roc_auc(df).first()[0] == pytest.approx(E._auc(rows))
    ordered, tp, area = sorted(rows, key=lambda x: (-x[0], not x[1])), 0, 0.0
    for i, (_, y) in enumerate(ordered, 1):
        tp += y
        area += y * tp / i
    assert E.pr_auc(df).first()[0] == pytest.approx(area / tp)
    empty = df.limit(0)
    assert E.roc_auc(empty).first()[0] is None and tuple(E.best_threshold(empty).first()) == (100.0, False)
    assert all(0 <= r.low <= r.high <= 1 for r in E.bootstrap(df, 6.0, n=50).collect())


def test_components_and_split(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "a string, b string")
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "node string")
    got = E.same_components(edges, nodes, f"file://{tmp_path}/c")
    assert {r.node: r.component for r in got.collect()} == {**dict.fromkeys("abc", "a"), **dict.fromkeys("de", "d"), "f": "f", "g": "g"}
    parts = {r.node: r.part for r in E.split_components(got).collect()}
    assert len(parts) == 7 and parts["a"] == parts["b"] == parts["c"]


def test_allocation_and_refresh(spark):
    from datetime import date

    got = {r.stratum: r.take for r in B.allocation(spark.createDataFrame([("x", 5), ("y", 3), ("z", 1)], "stratum string, n long"), 4).collect()}
    assert got == {"x": 2, "y": 1, "z": 1}
    assert B.refresh_due(date(2026, 1, 1), date(2026, 1, 2), True, 100, 10) and not B.refresh_due(date(2026, 1, 1), date(2026, 1, 2), True, 100, 9)


def test_ingest_json_and_csv(spark, tmp_path):
    import csv
    import json

    row = {"id": "m-1", "user": "acct-a", "game": "game-a", "time": "2026-10-01T12:00:00Z", "body": "  Hi! 🙂  ", "channel": "channel-a", "system": "false"}
    (tmp_path / "a.json").write_text(json.dumps([row]))
    with open(tmp_path / "a.csv", "w", newline="") as f:
        w = csv.DictWriter(f, row)
        w.writeheader()
        w.writerow(row)
    settings = IngestSettings(field_map={"message_id": "id", "account_id": "user", "game_id": "game", "timestamp_utc": "time", "text": "body", "channel_id": "channel"}, system_flag_field="system")
    a, b = (chatlog.ingest(spark, [f"file://{tmp_path}/a.{k}"], settings).drop("source_id") for k in ("json", "csv"))
    assert a.collect() == b.collect() and a.first().text == "  Hi! 🙂  "
    both = chatlog.ingest(spark, [f"file://{tmp_path}/a.json", f"file://{tmp_path}/a.csv"], settings)
    assert chatlog.checked_duplicates(both).count() == 1
    with pytest.raises(ContractError):
        chatlog.checked_duplicates(both, dedupe=False)
    assert chatlog.term_list("# comment\n# lang: en-US\n\nCafé\nCafé\n beta \n") == (["Café", "beta"], "en-US")
    with pytest.raises(ContractError):
        chatlog.file_format("x.txt")


def test_every_sql_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and math.isfinite(len(__spark_entry__.queries()))


def test_stream_sessions(spark, tmp_path):
    from acctlens.streaming.sessions import run_once

    (tmp_path / "in").mkdir()
    rows = [("a", "2026-01-01T00:00:00Z"), ("a", "2026-01-01T00:29:00Z"), ("a", "2026-01-01T00:59:00Z"), ("b", "2026-01-03T00:00:00Z")]
    (tmp_path / "in/1.json").write_text("\n".join(f'{{"account_id":"{a}","ts":"{t}","text":"xy","is_system":false}}' for a, t in rows))
    run_once(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    assert sorted((r.account_id, r.n_messages) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [("a", 1), ("a", 2)]


def test_bootstrap_ci_takes_as_many_resamples_as_the_reference(monkeypatch):
    import inspect

    from acctlens.plans import catalogue2

    seen, shape = [], inspect.signature(E.bootstrap)

    def noted(*a, **b):
        call = shape.bind(*a, **b)
        call.apply_defaults()
        seen.append(call.arguments["n"])

    monkeypatch.setattr(E, "bootstrap", noted)
    monkeypatch.setattr(catalogue2, "_lab", lambda spark, d: None)
    monkeypatch.setattr(catalogue2, "_rounded", lambda rows: rows)
    catalogue2.bootstrap_ci(None, "")
    assert seen == [1000]
