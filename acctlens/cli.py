"""Command line: ingest logs, build baselines, compare accounts, evaluate labelled pairs. No text of a message is ever printed."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reports
from .functions.canonical import sha256_of
from .functions.text import mask_sql
from .operators import artifacts, baselines, chronobiology, compare, evaluate, prep, semantic, stylometry
from .schemas import ContractError, IngestSettings, PrepSettings, error_code_for
from .session import get_session, kept, scratch_folder
from .sources import adapters, chatlog, streams


def _terms(spark: SparkSession, path: str | None) -> list[str]:
    return chatlog.term_list("\n".join(r.value for r in spark.read.text(path).collect()))[0] if path else []


def _least(args) -> dict:
    return {"minimum_messages": args.minimum_messages, "minimum_chars": args.minimum_chars}


def ingest(spark: SparkSession, args) -> None:
    """Checked messages as three streams and profiles below the output folder."""
    settings = PrepSettings(**_least(args), hours=tuple(args.utc_hour) if args.utc_hour else None, retention_days=args.cache_retention_days)
    messages = chatlog.checked_duplicates(chatlog.ingest(spark, args.inputs, IngestSettings(format=args.input_format)))
    messages = kept(messages.withColumn("us", adapters.micros(F.col("timestamp_utc").cast("timestamp_ntz"))), "messages")
    terms, names = _terms(spark, args.game_terms), _terms(spark, args.usernames)
    used = prep.sessions(prep.hour_filter(prep.accept(messages), settings.hours), settings.idle_gap_minutes)
    streams.expire(spark, args.output, settings.retention_days)
    streams.write_streams(streams.stream_chunks(prep.chunks_by_chars(used, settings.chunk_target), lambda t: mask_sql(t, names, terms)), args.output)
    fingerprint = artifacts.prep_fingerprint(settings, sha256_of(terms), sha256_of(names))
    profiles = prep.profiles(messages, settings).withColumn("preprocessing_fingerprint", F.lit(fingerprint))
    profiles.write.mode("overwrite").parquet(f"{args.output}/profiles")


class Stored:
    """Profiles and streams below a folder, and the engines' vectors of them."""

    def __init__(self, spark: SparkSession, folder: str, words: list[str]):
        self.profiles = spark.read.parquet(f"{folder}/profiles")
        self.streams = {k: streams.checked_stream(spark, folder, k) for k in streams.FIELDS}
        self.words = words

    def vectors(self, accounts: DataFrame | None = None) -> dict[str, DataFrame]:
        """Each engine reads its own stream; statistics are of the accounts given (account_id), or of the ready ones."""
        fitted = self.profiles.filter("status = 'READY'").select("account_id") if accounts is None else accounts
        raw = self.streams["raw"].select("account_id", F.explode(F.arrays_zip("message_ids", "raw_text")).alias("m")).select("account_id", F.col("m.message_ids").alias("message_id"), F.col("m.raw_text").alias("text"))
        texts = self.streams["normalized"].select("account_id", F.col("normalized_text").alias("text"))
        vocab = {w: i for i, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]"])}
        windows = semantic.window_rows(texts, vocab)
        embedded, _ = semantic.embed(windows, semantic.SyntheticModel())
        own = windows.select(F.col("id").alias("account_id"), "key").join(embedded, "key").select("account_id", "embedding")
        t = self.streams["temporal"].select("account_id", "session_id", F.explode(F.arrays_zip("timestamps_utc", "char_counts")).alias("m"))
        t = t.select("account_id", adapters.micros(F.col("m.timestamps_utc").cast("timestamp_ntz")).alias("us"), F.col("m.char_counts").alias("len"), "session_id")
        t = t.withColumn("message_id", F.lit("")).withColumn("game_id", F.col("session_id"))
        features = kept(chronobiology.features(kept(prep.sessions(t).select("account_id", "session", "seq", (F.col("us") / 1e6).alias("t"), "len"), "events")), "features")
        stats = chronobiology.fit(features.join(fitted, "account_id", "left_semi"))
        made = {"stylometry": stylometry.style_vectors(raw, self.words, fitted_on=fitted), "semantic": compare.semantic_vectors(own, fitted), "chronobiology": chronobiology.vectors(features, stats)}
        return {k: kept(v, k) for k, v in made.items()}

    def fingerprint(self, engine: str) -> str:
        prepared = self.profiles.agg(F.min("preprocessing_fingerprint"), F.max("preprocessing_fingerprint")).first()
        if prepared[0] is None or prepared[0] != prepared[1]:
            raise ContractError("preprocessing_fingerprint")
        return artifacts.engine_fingerprint(engine, {"function_words": sha256_of(self.words)}, prepared[0])


def build_baseline(spark: SparkSession, args) -> None:
    """A cosine distribution of known-different pairs for each engine, never overwritten."""
    stored = Stored(spark, args.profiles, _terms(spark, args.function_words))
    pairs = baselines.eligible(chatlog.labelled_pairs(spark, args.pairs), stored.profiles)
    pairs = kept(baselines.sample(pairs, args.max_pairs, args.seed), "pairs")
    baselines.require_pairs(pairs.count(), args.min_pairs)
    for engine, vectors in stored.vectors().items():
        made = compare.baseline_of(pairs, engine, vectors, stored.fingerprint(engine), **_least(args))
        artifacts.save(made.cosines, f"{args.output}/{engine}", "baseline", engine=engine, fingerprint=made.fingerprint, **_least(args))


def _compare(spark: SparkSession, args) -> list[str]:
    stored = Stored(spark, args.profiles, _terms(spark, args.function_words))
    pairs = spark.createDataFrame([(args.flagged, s) for s in sorted(set(args.suspect))], "a string, b string")
    engines = []
    for engine, vectors in stored.vectors().items():
        rows, about = artifacts.load(spark, f"{args.baseline}/{engine}", "baseline", engine=engine)
        base = compare.Baseline(engine, about["fingerprint"], rows, about["minimum_messages"], about["minimum_chars"])
        engines.append(compare.Engine(engine, vectors, stored.fingerprint(engine), base, args.minimum_messages, args.minimum_chars, streams.stream_totals(stored.streams["temporal"])))
    rows = compare.compare(pairs, stored.profiles, engines).orderBy("b").collect()  # a row for each suspect asked for
    return [reports.comparison(r.asDict(), args.format) for r in rows]


def _evaluate(spark: SparkSession, args) -> list[str]:
    stored = Stored(spark, args.profiles, _terms(spark, args.function_words))
    labelled = chatlog.labelled_pairs(spark, args.pairs).select("a", "b", "label")
    out = evaluate.evaluate(labelled, stored.profiles, stored.vectors, scratch_folder(spark, "evaluate"), **_least(args))
    return [reports.evaluation([r.asDict() for r in out.collect()], args.format)]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="acctlens")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *needed: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        p.add_argument("--minimum-messages", type=int, default=200)
        p.add_argument("--minimum-chars", type=int, default=5000)
        return p

    p = command("ingest", "output")
    p.add_argument("inputs", nargs="+")
    p.add_argument("--input-format", choices=("auto", "json", "csv"), default="auto")
    p.add_argument("--utc-hour", action="append", type=int)
    p.add_argument("--cache-retention-days", type=int, default=7)
    p.add_argument("--game-terms")
    p.add_argument("--usernames")
    p = command("build-baseline", "pairs", "profiles", "output", "function-words")
    p.add_argument("--max-pairs", type=int, default=50_000)
    p.add_argument("--min-pairs", type=int, default=1000)
    p.add_argument("--seed", type=int, default=1729)
    p = command("compare", "profiles", "flagged", "baseline", "function-words")
    p.add_argument("--suspect", required=True, action="append")
    p.add_argument("--format", choices=("table", "json"), default="table")
    p = command("evaluate", "pairs", "profiles", "function-words")
    p.add_argument("--format", choices=("table", "json"), default="table")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 with a field's name and a stable code on stderr."""
    args = parser().parse_args(argv)
    spark = spark or get_session("acctlens")
    run = {"ingest": ingest, "build-baseline": build_baseline, "compare": _compare, "evaluate": _evaluate}[args.command]
    try:
        for text in run(spark, args) or []:
            print(text)
    except Exception as e:  # what went wrong may hold texts; only its code is told
        print(str(e) if isinstance(e, ContractError) else error_code_for(e), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
