"""Ids, casefolding, comparison, evaluation, stored streams, artifacts, reports and the command line, against plain Python."""

import hashlib
import json
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from acctlens import cli, reports
from acctlens.functions import text as X
from acctlens.functions.canonical import canonical_json, json_string
from acctlens.functions.ranges import running
from acctlens.operators import artifacts, compare
from acctlens.operators import evaluate as E
from acctlens.operators import prep as P
from acctlens.operators import semantic as S
from acctlens.operators import stylometry as Y
from acctlens.schemas import ContractError, ErrorCode, IngestSettings, PrepSettings
from acctlens.sources import chatlog, streams

from test_engine import MESSAGES


def test_casefolded_tokens(spark):
    odd = "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isalpha() and c.casefold() != c.lower())
    texts = ["Straße ΣΟΦΟΣ İx 12ab_cd", "", " ".join(odd), "plain words, Only"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.alphabetic_tokens(F.col("t")).alias("w")).orderBy("i").collect()
    for r, t in zip(got, texts):
        assert [w for w in r.w] == X.casefolded_tokens(t)
    words, digest = Y.listed_words(["Ab", "aB", "e\u0301"])
    assert words == ["ab", "é"] and digest == hashlib.sha256(b'{"function_words":["Ab","aB","\xc3\xa9"],"language":"und"}').hexdigest()


def test_ids_of_sessions_and_chunks(spark):
    rows = [("a\"c", f"m\\{i}\n\x1f", "gé", None, i * 60_000_000, "text", False, "s", i) for i in range(7)]
    c = P.with_ids(P.chunks_by_messages(P.sessions(spark.createDataFrame(rows, MESSAGES)), 3)).orderBy("seq").collect()
    sha = lambda kind, x: f"{kind}-" + hashlib.sha256(canonical_json(x)).hexdigest()
    keys = [json.dumps([r[2], r[1]], ensure_ascii=False, separators=(",", ":")) for r in rows]
    session = sha("session", ["a\"c", 0, keys])
    for k, r in enumerate(c):
        own = keys[k // 3 * 3 : k // 3 * 3 + 3]
        assert r.session_id == session and r.chunk_id == sha("chunk", ["a\"c", session, own])
    texts = ["", "\"\\/\b\t", "\u2028é🙂", "\x00\x7f"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(json_string(F.col("t")).alias("j")).collect()
    assert [r.j for r in got] == [json.dumps(t, ensure_ascii=False) for t in texts]


def test_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice([rng.random(), round(rng.random(), 1)]), rng.randint(0, 5)) for _ in range(700)]
    df = spark.createDataFrame(rows, "k double, n long")
    for down in (False, True):
        for r in running(df, "k", {"total": "n"}, down, 16).collect():
            assert r.total == sum(n for k, n in rows if (k >= r.k if down else k <= r.k))
    assert running(df.limit(0), "k", {"total": "n"}).count() == 0


def test_windows_have_their_frame():
    vocab = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "a": 4, "##a": 5, "b": 6}
    assert S.windows("b aaaa b", vocab, 5) == [("b ", [2, 6, 3]), ("aaaa b", [2, 1, 6, 3])]
    assert S.windows(" ", vocab, 5) == [(" ", [2, 3])]


def engines(spark, vectors, base, **changes):
    out = []
    for e in ("stylometry", "semantic", "chronobiology"):
        b = compare.Baseline(e, "f", spark.createDataFrame([(x,) for x in base], "cosine double"), 1, 1)
        out.append(compare.Engine(e, vectors, "f", b, 1, 1))
    return out


def test_comparison_ladder_and_fusion(spark):
    accounts = {"a": (1.0, 0.0), "b": (0.6, 0.8), "c": (0.0, 0.0), "d": (1.0, 0.0), "e": (1.0, 0.0)}
    vectors = spark.createDataFrame([(k, i, x) for k, v in accounts.items() for i, x in enumerate(v)], "account_id string, idx int, w double")
    profiles = spark.createDataFrame([(k, "READY" if k != "d" else "INSUFFICIENT_DATA", 10, 10) for k in accounts], "account_id string, status string, n_messages long, n_chars long")
    pairs = spark.createDataFrame([("a", x) for x in "bcdez"], "a string, b string")
    three = engines(spark, vectors, [0.1, 0.6, 0.7, 0.9])
    totals = spark.createDataFrame([(k, 10 if k != "e" else 9, 10) for k in accounts], "account_id string, n_messages long, n_chars long")
    three[0] = compare.Engine(**{**three[0].__dict__, "totals": totals})
    three[2] = compare.Engine(**{**three[2].__dict__, "fingerprint": "other"})
    got = {r.b: r for r in compare.compare(pairs, profiles, three).collect()}
    assert {r.chronobiology_error for r in got.values()} == {"BASELINE_CONFIG_MISMATCH", "MINIMUMS_NOT_MET"}
    assert (got["b"].stylometry_cosine, got["b"].stylometry_percentile, got["b"].status, got["b"].active_engines) == (pytest.approx(0.6), 50, "OK", "stylometry,semantic")
    assert got["c"].semantic_error == "ENGINE_FAILURE" and got["c"].status == "ERROR" and got["c"].combined_score is None
    assert got["d"].stylometry_status == got["z"].semantic_status == "INSUFFICIENT_DATA"
    assert got["e"].stylometry_error == "INPUT_INVALID" and got["e"].semantic_status == "OK"
    bad = compare.Baseline("semantic", "f", spark.createDataFrame([(2.0,)], "cosine double"), 1, 1)
    assert compare.incompatibility(bad, "semantic", "f") == ErrorCode.BASELINE_INVALID
    assert compare.incompatibility(bad, "stylometry", "f") == ErrorCode.BASELINE_CONFIG_MISMATCH
    text = reports.comparison(got["b"].asDict())
    assert text.startswith(reports.BANNER) and "0.600000" in text and text.endswith(reports.HEURISTIC)
    assert json.loads(reports.comparison(got["b"].asDict(), "json").split("\n", 1)[1])["banner"] == reports.BANNER


def test_evaluation_on_held_out_accounts(spark, tmp_path):
    rng = random.Random(3)
    people = 60
    angle = {f"{p}{k}": 2 * math.pi * p / people + 0.001 * (k == "y") for p in range(people) for k in "xy"}
    vectors = spark.createDataFrame([(a, i, f(x)) for a, x in angle.items() for i, f in enumerate((math.cos, math.sin))], "account_id string, idx int, w double")
    profiles = spark.createDataFrame([(a, "READY", 5, 5) for a in angle], "account_id string, status string, n_messages long, n_chars long")
    pairs = [(f"{p}x", f"{p}y", "same") for p in range(people)]
    pairs += [(f"{p}x", f"{q}y", "different") for p in range(people) for q in rng.sample(range(people), 12) if p != q]
    labelled = spark.createDataFrame(pairs, "a string, b string, label string")
    asked = []

    def fit(accounts):
        asked.append({r.account_id for r in accounts.collect()})
        return dict.fromkeys(("stylometry", "semantic", "chronobiology"), vectors)

    rows = {r.engine: r for r in E.evaluate(labelled, profiles, fit, f"file://{tmp_path}/e", 1, 1, n_bootstrap=40).collect()}
    _, dealt = E.held_out(labelled, f"file://{tmp_path}/h")
    parts = defaultdict(list)
    for r in dealt.collect():
        parts[r.part].append(r)
    members = {p: {x for r in rs for x in (r.a, r.b)} for p, rs in parts.items()}
    assert not members["train"] & members["test"] and members["train"] <= asked[0] and not asked[0] & members["test"]
    assert set(rows) == {"stylometry", "semantic", "chronobiology", "combined"}
    for r in rows.values():
        assert r.support_same + r.support_different == len(parts["test"]) and r.n_excluded == 0
        assert r.roc_auc > 0.99 and r.recall == 1 and r.roc_auc_low <= r.roc_auc <= r.roc_auc_high + 1e-9
    assert "combined" in reports.evaluation([r.asDict() for r in rows.values()])
    with pytest.raises(ContractError, match="training_baselines:MINIMUMS_NOT_MET"):
        E.evaluate(labelled.filter("label = 'same'"), profiles, fit, f"file://{tmp_path}/n", 1, 1)


def test_stored_streams_and_their_checks(spark, tmp_path):
    rows = [(a, f"m{i}", "g", None, i * 1_234_567 + (i // 5) * 3_600_000_000, f"Hé {i} www.x.y", False, "s", i) for a in ("p", "q") for i in range(12)]
    chunked = P.chunks_by_chars(P.sessions(spark.createDataFrame(rows, MESSAGES)), 30)
    at = f"file://{tmp_path}/s"
    streams.write_streams(streams.stream_chunks(chunked, X.mask_sql), at)
    raw, normal, times = (streams.checked_stream(spark, at, k) for k in ("raw", "normalized", "temporal"))
    assert {(r.account_id, r.n_messages, r.n_chars) for r in streams.stream_totals(times).collect()} == {(a, 12, sum(len(r[5]) for r in rows if r[0] == a)) for a in "pq"}
    assert sorted(t for r in raw.collect() for t in r.raw_text) == sorted(r[5] for r in rows) and all("[URL]" in r.normalized_text and "www" not in r.normalized_text for r in normal.collect())
    assert "1970-01-01T00:00:01.234567Z" in {t for r in times.collect() for t in r.timestamps_utc}
    key = hashlib.sha256(b"p").hexdigest()
    line = json.loads(next(iter((tmp_path / "s/raw" / f"account_key={key}").glob("part-*"))).read_text().splitlines()[0])
    assert list(line) == sorted(streams.FIELDS["raw"])
    for change, field in (({"n_chars": 1}, "n_chars"), ({"account_id": "z"}, "account_id"), ({"extra": 1}, "json"), ({"schema_version": "2"}, "schema_version")):
        bad = tmp_path / f"bad-{field}" / "raw" / f"account_key={key}"
        bad.mkdir(parents=True)
        (bad / "part-0.txt").write_text(json.dumps(line | change) + "\n")
        with pytest.raises(ContractError, match=f"{field}:ARTIFACT_INVALID"):
            streams.checked_stream(spark, f"file://{tmp_path}/bad-{field}", "raw")
    assert streams.expire(spark, at, 7) == 0 and streams.expire(spark, at, 0, 1e12) == 0 and streams.expire(spark, at, 7, 1e12) == 6


def test_artifacts_are_immutable_and_checked(spark, tmp_path):
    rows = spark.createDataFrame([(i, i / 7) for i in range(50)], "idx int, mean double")
    at = f"file://{tmp_path}/a"
    artifacts.save(rows, at, "baseline", engine="semantic")
    got, about = artifacts.load(spark, at, "baseline", engine="semantic")
    assert sorted(got.collect()) == sorted(rows.collect()) and about["sha256"] == artifacts.table_digest(rows.repartition(5))
    for kind, expected, code in (("fit", {}, "ARTIFACT_INVALID"), ("baseline", {"engine": "x"}, "BASELINE_CONFIG_MISMATCH")):
        with pytest.raises(ContractError, match=code):
            artifacts.load(spark, at, kind, **expected)
    with pytest.raises(ContractError):
        artifacts.save(rows, at, "baseline")
    rows.limit(10).write.mode("append").parquet(f"{at}/rows")
    with pytest.raises(ContractError):
        artifacts.load(spark, at, "baseline")
    one = artifacts.prep_fingerprint(PrepSettings(), "t", "u")
    assert one == artifacts.prep_fingerprint(PrepSettings(retention_days=1), "t", "u") != artifacts.prep_fingerprint(PrepSettings(idle_gap_minutes=1), "t", "u")


def test_records_that_are_none(spark, tmp_path):
    for name, text, field in (("a.json", "", "json"), ("b.json", "\n \n", "json"), ("c.json", "1\n2", "record"), ("d.json", '[1]', "json"), ("e.json", '{"x": NaN}', "json"), ("f.csv", "", "csv_header"), ("g.csv", "a\n1,2\n", "csv_row")):
        with pytest.raises(ContractError, match=f"^{field}:"):
            chatlog._records(text.encode(), name[-4:].strip("."))
    assert chatlog._records(b'{"messages": []}', "json") == [] and chatlog._records(b'{"a": 1}\n\n{"a": 2}', "json") == [{"a": 1}, {"a": 2}]
    assert IngestSettings().dedupe


def test_command_line_from_logs_to_report(spark, tmp_path, capsys):
    rng = random.Random(9)
    logs = [{"account_id": f"acc{a}", "message_id": f"{a}-{i}", "game_id": "g", "timestamp_utc": f"2026-01-{1 + i % 20:02}T{rng.randrange(24):02}:{rng.randrange(60):02}:{i % 60:02}Z", "text": " ".join(rng.choice("hey gg the and lol of to 77".split()) for _ in range(6))} for a in range(4) for i in range(25)]
    (tmp_path / "log.json").write_text(json.dumps(logs))
    (tmp_path / "words.txt").write_text("the\nand\nof\n")
    pairs = [{"schema_version": "1.0", "account_id_a": f"acc{a}", "account_id_b": f"acc{b}", "label": "different", "source_snapshot_id": "s"} for a in range(4) for b in range(a)]
    (tmp_path / "pairs.ndjson").write_text("\n".join(map(json.dumps, pairs)))
    at, least = f"file://{tmp_path}", ["--minimum-messages", "5", "--minimum-chars", "20"]
    words = ["--function-words", f"{at}/words.txt"]
    assert cli.main(["ingest", f"{at}/log.json", "--output", f"{at}/out", *least], spark) == 0
    base = ["build-baseline", "--pairs", f"{at}/pairs.ndjson", "--profiles", f"{at}/out", "--output", f"{at}/base", "--min-pairs", "6", *words, *least]
    assert cli.main(base, spark) == 0
    assert cli.main(base, spark) == 1 and capsys.readouterr().err == "output:ARTIFACT_INVALID\n"
    assert cli.main(["compare", "--profiles", f"{at}/out", "--baseline", f"{at}/base", "--flagged", "acc0", "--suspect", "acc2", "--suspect", "acc9", *words, *least], spark) == 0
    out = capsys.readouterr().out
    assert out.count(reports.BANNER) == 2 and "INSUFFICIENT_DATA" in out and "stylometry,semantic,chronobiology" in out and "lol" not in out
