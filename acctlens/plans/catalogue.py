"""The engine's queries over the test tables, each with the DuckDB SQL that gives the same rows (where SQL can)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import baselines as B
from ..operators import calibration as C
from ..operators import chronobiology as K
from ..operators import evaluate as E
from ..operators import prep as P
from ..operators import semantic as S
from ..operators import stylometry as Y
from ..schemas import PrepSettings
from ..sources import adapters as A

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Settings of the queries over the small test accounts.
SMALL = PrepSettings(minimum_messages=40, minimum_chars=500)
WORDS = ("the", "and", "of", "to", "in", "is", "that", "it", "de", "la", "le", "und", "die", "el")
LONG_GAP = 720

EV = """ev AS (SELECT CAST(user_id AS VARCHAR) AS account_id, CAST(event_id AS VARCHAR) AS message_id, event_type AS game_id, regexp_extract(props, '"k": *([0-9]+)', 1) AS channel_id,
  epoch_us(CAST(ts AS TIMESTAMP)) AS us, event_type || ' ' || props AS text, event_type = 'error' AS is_system, event_id + 1 AS source_row FROM events),
acc AS (SELECT *, length(text) AS len, (us // 3600000000) % 24 AS hour FROM ev WHERE NOT is_system AND length(text) > 0)"""


def _sessions_sql(gap: int, of: str = "acc", name: str = "ses") -> str:
    return f"""{name}_l AS (SELECT *, us - lag(us) OVER w AS gap_us, row_number() OVER w AS seq FROM {of} WINDOW w AS (PARTITION BY account_id ORDER BY us, message_id, game_id)),
{name} AS (SELECT * EXCLUDE (gap_us), CAST(sum(CASE WHEN gap_us >= {gap * 60_000_000} THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY us, message_id, game_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session, us / 1e6 AS t FROM {name}_l)"""


SES, SES12 = f"WITH {EV}, {_sessions_sql(30)}", f"WITH {EV}, {_sessions_sql(LONG_GAP)}"


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return put


def r(column, digits: int = 6):
    """Rounded with an offset against ties, as in the SQL."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c + 1e-9, digits)


def _ev(spark, d):
    return A.events(spark, d)


def _acc(spark, d):
    return P.accept(_ev(spark, d))


def _ses(spark, d, gap=30):
    return P.sessions(_acc(spark, d), gap)


def _k(spark, d, gap=LONG_GAP):
    return K.events(_ses(spark, d, gap))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[r(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Filters and sources -------------------------------------------------------------------------------


@query(f"WITH {EV} SELECT account_id, message_id, text FROM acc")
def accept_filter(spark, d):
    return _acc(spark, d).select("account_id", "message_id", "text")


@query(f"WITH {EV} SELECT account_id, message_id FROM acc WHERE hour IN (0, 6, 12, 18)")
def hour_filter(spark, d):
    return P.hour_filter(_acc(spark, d), (0, 6, 12, 18)).select("account_id", "message_id")


@query(f"WITH {EV}, h AS (SELECT account_id, hour, count(*) AS n FROM acc GROUP BY ALL), a AS (SELECT DISTINCT account_id FROM acc), g AS (SELECT account_id, unnest(range(24)) AS hour FROM a) SELECT g.account_id, g.hour, CAST(coalesce(n, 0) AS BIGINT) AS n FROM g LEFT JOIN h ON g.account_id = h.account_id AND g.hour = h.hour")
def activity_histogram24(spark, d):
    return P.histogram24(_acc(spark, d)).select("account_id", F.posexplode("activity").alias("hour", "n")).select("account_id", F.col("hour").cast("long").alias("hour"), "n")


@query("SELECT event_id, CASE WHEN lower(trim(event_type)) IN ('error', 'signup') THEN true ELSE false END AS is_system FROM events")
def system_flag_map(spark, d):
    from ..sources.chatlog import system_flag

    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", system_flag(F.when(F.col("event_type").isin("error", "signup"), F.col("event_type")).otherwise("false"), ("error", "signup")).alias("is_system"))


@query("SELECT CAST(user_id AS VARCHAR) AS account_id, CAST(event_id AS VARCHAR) AS message_id, event_type AS game_id, props AS text FROM events")
def field_map_projection(spark, d):
    from ..sources.chatlog import map_fields

    return map_fields(spark.read.parquet(f"{d}/events.parquet"), {"account_id": "user_id", "message_id": "event_id", "game_id": "event_type", "text": "props"})


@query("SELECT event_id, CASE WHEN value < 0 OR value IS NULL THEN 'value' WHEN event_id % 97 = 0 THEN 'account_id' WHEN event_type = 'signup' THEN 'channel_id' END AS error FROM events")
def validate_rows(spark, d):
    from ..sources.chatlog import first_error

    e = spark.read.parquet(f"{d}/events.parquet")
    rules = [("value", (F.col("value") < 0) | F.col("value").isNull()), ("account_id", F.col("event_id") % 97 == 0), ("channel_id", F.col("event_type") == "signup")]
    return e.select("event_id", first_error(rules).alias("error"))


@query(f"WITH {EV}, u AS (SELECT *, 'a' AS source_id FROM ev UNION ALL SELECT *, 'b' FROM ev WHERE source_row % 3 = 0) SELECT game_id, message_id, arg_min(source_id, source_id) AS source_id FROM u GROUP BY ALL")
def dedupe_messages(spark, d):
    e = _ev(spark, d)
    both = e.withColumn("source_id", F.lit("a")).union(e.filter("source_row % 3 = 0").withColumn("source_id", F.lit("b")))
    return P.dedupe(both)[0].select("game_id", "message_id", "source_id")


@query(f"WITH {EV} SELECT game_id, message_id, CAST(2 AS BIGINT) AS n FROM ev WHERE source_row % 50 = 0")
def dedupe_conflicts(spark, d):
    e = _ev(spark, d)
    other = e.filter("source_row % 50 = 0").withColumn("text", F.concat("text", F.lit("!"))).withColumn("source_id", F.lit("b"))
    return P.dedupe(e.union(other))[1]


@query("SELECT event_id, sha256(CAST(user_id AS VARCHAR)) AS account_key FROM events")
def account_key(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.sha2(F.col("user_id").cast("string"), 256).alias("account_key"))


@query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def text_sha256(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("text_sha256"))


# Order, sessions, chunks ---------------------------------------------------------------------------


@query(f"{SES} SELECT account_id, message_id, seq FROM ses")
def message_order(spark, d):
    return _ses(spark, d).select("account_id", "message_id", F.col("seq").cast("long").alias("seq"))


def _gap_queries(gap, suffix):
    sql = f"WITH {EV}, {_sessions_sql(gap)}"

    @query(f"{sql} SELECT account_id, message_id, session FROM ses", f"sessions_gap_{suffix}")
    def rows(spark, d):
        return _ses(spark, d, gap).select("account_id", "message_id", "session")

    @query(f"{sql} SELECT account_id, session, count(*) AS n_messages, CAST(sum(len) AS BIGINT) AS n_chars, min(us) AS start_us, max(us) AS end_us FROM ses GROUP BY ALL", f"session_stats_{suffix}")
    def stats(spark, d):
        return _ses(spark, d, gap).groupBy("account_id", "session").agg(F.count("*").alias("n_messages"), F.sum(F.length("text")).alias("n_chars"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


_gap_queries(30, "30m")
_gap_queries(LONG_GAP, "12h")

_BY_MESSAGES = f"{SES12}, ch AS (SELECT *, (row_number() OVER (PARTITION BY account_id, session ORDER BY seq) - 1) // 3 AS chunk FROM ses)"


@query(f"{_BY_MESSAGES} SELECT account_id, session, CAST(chunk AS INTEGER) AS chunk, count(*) AS n_messages, CAST(sum(len) AS BIGINT) AS n_chars, string_agg(message_id, ',' ORDER BY seq) AS ids FROM ch GROUP BY ALL")
def chunks_by_messages(spark, d):
    c = P.chunk_rows(P.chunks_by_messages(_ses(spark, d, LONG_GAP), 3))
    return c.select("account_id", "session", "chunk", "n_messages", "n_chars", F.array_join("message_ids", ",").alias("ids"))


@query(
    f"""WITH RECURSIVE {EV}, {_sessions_sql(LONG_GAP)}, s AS (SELECT account_id, session, seq, len, row_number() OVER (PARTITION BY account_id, session ORDER BY seq) AS i FROM ses),
f AS (SELECT account_id, session, seq, i, 0 AS chunk, CASE WHEN len >= 60 THEN 0 ELSE len END AS filled, CASE WHEN len >= 60 THEN 1 ELSE 0 END AS next FROM s WHERE i = 1
 UNION ALL SELECT s.account_id, s.session, s.seq, s.i, x.chunk, CASE WHEN x.size >= 60 THEN 0 ELSE x.size END, x.chunk + CASE WHEN x.size >= 60 THEN 1 ELSE 0 END
 FROM f JOIN s ON s.account_id = f.account_id AND s.session = f.session AND s.i = f.i + 1,
 LATERAL (SELECT CASE WHEN f.filled > 0 AND f.filled + s.len > 60 THEN f.next + 1 ELSE f.next END AS chunk, CASE WHEN f.filled > 0 AND f.filled + s.len > 60 THEN s.len ELSE f.filled + s.len END AS size) x)
SELECT account_id, session, seq, CAST(chunk AS INTEGER) AS chunk FROM f"""
)
def chunks_by_chars(spark, d):
    return P.chunks_by_chars(_ses(spark, d, LONG_GAP), 60).select("account_id", "session", F.col("seq").cast("long").alias("seq"), "chunk")


_KEY = """'"[\\"' || game_id || '\\",\\"' || message_id || '\\"]"'"""
_IDS = f"""{_BY_MESSAGES}, si AS (SELECT account_id, session, 'session-' || sha256('["' || account_id || '",' || CAST(session AS VARCHAR) || ',[' || string_agg({_KEY}, ',' ORDER BY seq) || ']]') AS session_id FROM ch GROUP BY account_id, session),
ci AS (SELECT account_id, session, chunk, string_agg({_KEY}, ',' ORDER BY seq) AS keys FROM ch GROUP BY ALL)"""


def _with_ids(spark, d):
    return P.with_ids(P.chunks_by_messages(_ses(spark, d, LONG_GAP), 3))


@query(f"{_IDS} SELECT account_id, session, session_id FROM si")
def session_ids_sha256(spark, d):
    return _with_ids(spark, d).select("account_id", "session", "session_id").distinct()


@query(f"""{_IDS} SELECT ci.account_id, ci.session, CAST(ci.chunk AS INTEGER) AS chunk, 'chunk-' || sha256('["' || ci.account_id || '","' || session_id || '",[' || keys || ']]') AS chunk_id FROM ci JOIN si ON si.account_id = ci.account_id AND si.session = ci.session""")
def chunk_ids(spark, d):
    return _with_ids(spark, d).select("account_id", "session", "chunk", "chunk_id").distinct()


@query(f"{_BY_MESSAGES} SELECT account_id, session, CAST(chunk AS INTEGER) AS chunk, string_agg(CAST(us AS VARCHAR), ',' ORDER BY seq) AS times, string_agg(CAST(len AS VARCHAR), ',' ORDER BY seq) AS lens FROM ch GROUP BY ALL")
def temporal_stream(spark, d):
    t = P.temporal_stream(P.chunks_by_messages(_ses(spark, d, LONG_GAP), 3))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return t.select("account_id", "session", "chunk", join("timestamps_us").alias("times"), join("char_counts").alias("lens"))


@query(f"{_BY_MESSAGES}, c AS (SELECT account_id, session, chunk, string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), chr(10) ORDER BY seq) AS normalized_text FROM ch GROUP BY ALL) SELECT account_id, session, CAST(chunk AS INTEGER) AS chunk, normalized_text, sha256(normalized_text) AS normalized_sha256 FROM c")
def normalized_stream(spark, d):
    c = P.chunk_rows(P.chunks_by_messages(_ses(spark, d, LONG_GAP), 3))
    out = P.normalized_stream(c, lambda texts: F.array_join(F.transform(texts, X.collapse), "\n"))
    return out.drop("n_messages")


# Profiles ------------------------------------------------------------------------------------------


def _mode_sql(column, name):
    return f"WITH {EV}, n AS (SELECT account_id, {column} AS v, count(*) AS n FROM acc WHERE {column} IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY n DESC, v) AS k FROM n) SELECT account_id, v AS {name} FROM r WHERE k = 1"


@query(_mode_sql("game_id", "primary_game"))
def primary_game_mode(spark, d):
    return P.most_common(_acc(spark, d), "account_id", "game_id", "primary_game")


@query(_mode_sql("channel_id", "primary_channel"))
def primary_channel(spark, d):
    return P.most_common(_acc(spark, d), "account_id", "channel_id", "primary_channel")


_PROFILES = f"""{SES}, c AS (SELECT account_id, count(*) AS n_messages, CAST(sum(len) AS BIGINT) AS n_chars, max(session) + 1 AS session_count, string_agg(DISTINCT strftime(make_timestamp(us), '%Y-%m'), ',' ORDER BY strftime(make_timestamp(us), '%Y-%m')) AS active_months, string_agg(DISTINCT game_id, ',' ORDER BY game_id) AS games FROM ses GROUP BY ALL),
pf AS (SELECT *, CASE WHEN n_messages >= 40 AND n_chars >= 500 THEN 'READY' ELSE 'INSUFFICIENT_DATA' END AS status FROM c)"""


@query(f"{_PROFILES} SELECT account_id, active_months FROM pf")
def active_months(spark, d):
    return P.profiles(_ev(spark, d), SMALL).select("account_id", F.array_join("active_months", ",").alias("active_months"))


@query(f"{_PROFILES} SELECT account_id, n_messages, n_chars, session_count, games, status FROM pf")
def profiles(spark, d):
    return P.profiles(_ev(spark, d), SMALL).select("account_id", "n_messages", "n_chars", "session_count", F.array_join("games", ",").alias("games"), "status")


@query("SELECT DISTINCT conv_id || ':' || role AS account_id FROM conversations WHERE role = 'system'")
def omitted_accounts(spark, d):
    return P.omitted_accounts(A.conversations(spark, d))


@query("SELECT DISTINCT account_id FROM (SELECT CAST(user_id AS VARCHAR) AS account_id FROM events UNION ALL SELECT source FROM documents)")
def set_union_accounts(spark, d):
    return _ev(spark, d).select("account_id").union(A.documents(spark, d).select("account_id")).distinct()


# Masking -------------------------------------------------------------------------------------------


@query()
def mask_chain(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return X.mask_exact(docs, usernames=("idiot",), game_terms=("the", "tion")).select("doc_id", F.sha2("masked", 256).alias("masked_sha256"))


@query()
def mask_chain_sql(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.sha2(X.mask_sql(F.col("text"), ("idiot",), ("the", "tion")), 256).alias("masked_sha256"))


@query("SELECT doc_id, sha256(regexp_replace(text, '(?i)\\b(?:https?://|www\\.)[^\\s]+', '[URL]', 'g')) AS masked_sha256 FROM documents")
def mask_url(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(X.mask_urls(F.col("text")), 256).alias("masked_sha256"))


@query("SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM documents")
def mask_ws_collapse(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.length(X.collapse(F.col("text"))).cast("long").alias("n"))


# Stylometry ----------------------------------------------------------------------------------------


def _structural(names, first, sql):
    def run(spark, d):
        s = Y.structural(A.documents(spark, d))
        return s.filter(F.col("idx").between(first, first + names - 1)).select("account_id", "idx", r("value", 7).alias("value"))

    return run, sql


def _struct_sql(idx, numerator, denominator="sum(length(text))"):
    return f"SELECT source AS account_id, CAST({idx} AS INTEGER) AS idx, round(CAST(sum({numerator}) AS DOUBLE) / {denominator} + 1e-9, 7) AS value FROM documents GROUP BY ALL"


_run, _sql = _structural(1, 0, _struct_sql(0, "length(text) - length(replace(text, ' ', '')) - len(regexp_extract_all(text, ' +'))"))
query(_sql, "struct_double_space")(_run)
_marks = " UNION ALL ".join(_struct_sql(i + 1, f"length(text) - length(replace(text, '{c if c != chr(39) else chr(39) * 2}', ''))") for i, c in enumerate(X.PUNCTUATION))
_run, _sql = _structural(32, 1, _marks)
query(_sql, "struct_punct")(_run)
_quote = lambda c: c.replace("'", "''")
_repeats = " + ".join(f"len(regexp_extract_all(text, '{_quote(re.escape(c))}{{2,}}'))" for c in X.PUNCTUATION) + " + length(text) - length(replace(text, '\u2026', ''))"
_repeated = _struct_sql(33, _repeats)
_run, _ = _structural(1, 33, None)
query(_repeated, "struct_repeat_punct")(_run)
_run, _sql = _structural(1, 34, _struct_sql(34, "length(regexp_replace(text, '[^\\p{Lu}]', '', 'g'))", "sum(length(regexp_replace(text, '[^\\p{L}]', '', 'g')))"))
query(_sql, "struct_upper_ratio")(_run)
# A run of a letter counts once, where it gets to three.
_elongated = """SELECT account_id, CAST(35 AS INTEGER) AS idx, round(CAST(sum(n) AS DOUBLE) / sum(size) + 1e-9, 7) AS value FROM (SELECT d.source AS account_id, length(d.text) AS size, coalesce(r.n, 0) AS n FROM documents d LEFT JOIN
(SELECT doc_id, count(CASE WHEN c = c1 AND c = c2 AND (c3 IS NULL OR c3 <> c) AND regexp_matches(c, '\\p{L}') THEN 1 END) AS n FROM (SELECT doc_id, c, lag(c, 1) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(c, 3) OVER w AS c3
FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE length(text) > 0) WINDOW w AS (PARTITION BY doc_id ORDER BY i)) GROUP BY doc_id) r ON r.doc_id = d.doc_id) GROUP BY account_id"""
_run, _ = _structural(1, 35, None)
query(_elongated, "struct_elongation")(_run)
_run, _sql = _structural(1, 36, _struct_sql(36, "len(regexp_extract_all(text, '[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2300}-\\x{23FF}]'))"))
query(_sql, "struct_emoji")(_run)
_run, _sql = _structural(1, 37, _struct_sql(37, "length(text)", "count(*)"))
query(_sql, "mean_len")(_run)


@query(
    "WITH t AS (SELECT source AS account_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS token FROM documents), n AS (SELECT account_id, count(*) AS n FROM t GROUP BY ALL), w AS (SELECT unnest(["
    + ", ".join(f"'{w}'" for w in WORDS)
    + "]) AS word), c AS (SELECT account_id, token, count(*) AS c FROM t GROUP BY ALL) SELECT n.account_id, w.word, round(coalesce(c.c, 0) / n.n + 1e-9, 7) AS freq FROM n CROSS JOIN w LEFT JOIN c ON c.account_id = n.account_id AND c.token = w.word"
)
def function_word_freq(spark, d):
    return Y.function_words(A.documents(spark, d), WORDS).select("account_id", "word", r("freq", 7).alias("freq"))


_every = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in [SQL["struct_double_space"], _marks, _repeated, SQL["struct_upper_ratio"], _elongated, SQL["struct_emoji"], SQL["mean_len"]])
_EXACT = _every.replace("round(", "(").replace(" + 1e-9, 7)", ")")


@query(f"WITH v AS ({_EXACT}) SELECT idx, round(avg(value) + 1e-9, 6) AS mean, round(stddev_pop(value) + 1e-9, 6) AS std FROM v GROUP BY ALL")
def struct_stats_fit(spark, d):
    s = V.fitted(Y.structural(A.documents(spark, d)))
    return s.select("idx", r("mean").alias("mean"), r("std").alias("std"))


@query(
    f"WITH v AS ({_EXACT}), st AS (SELECT idx, avg(value) AS m, stddev_pop(value) AS s FROM v GROUP BY ALL), z AS (SELECT account_id, v.idx, CASE WHEN s = 0 THEN 0 ELSE (value - m) / s END AS z FROM v JOIN st ON v.idx = st.idx) SELECT account_id, idx, round(z / sqrt(sum(z * z) OVER (PARTITION BY account_id)) + 1e-9, 4) AS w FROM z"
)
def standardize_block_l2(spark, d):
    s = Y.structural(A.documents(spark, d))
    z = V.standardize(s, V.fitted(s)).select("account_id", "idx", F.col("z").alias("w"))
    return V.unit(z).select("account_id", "idx", r("w", 4).alias("w"))


_GRAMS = "WITH c AS (SELECT source AS account_id, doc_id, string_split(text, '') AS c FROM documents WHERE length(text) >= 2), p AS (SELECT account_id, doc_id, unnest(list_zip(c[1:len(c) - 1], c[2:])) AS z FROM c), g AS (SELECT account_id, doc_id, z[1] || z[2] AS gram, count(*) AS n FROM p GROUP BY ALL)"
_IDF = "nd AS (SELECT count(*) AS nd FROM documents), i AS (SELECT gram, count(*) AS df, ln((1 + any_value(nd)) / (1 + count(*))) + 1 AS idf FROM g, nd GROUP BY gram)"
_TFIDF = "tf AS (SELECT account_id, gram, sum(n) AS n FROM g GROUP BY ALL), x AS (SELECT account_id, gram, n / sum(n) OVER (PARTITION BY account_id) * idf AS w FROM tf JOIN i USING (gram)), u AS (SELECT account_id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY account_id)) AS w FROM x)"


def _counts(spark, d):
    return Y.account_plain_grams(A.documents(spark, d), 2)


def _tfidf(spark, d):
    g, n = _counts(spark, d), A.documents(spark, d).count()
    return Y.tfidf(g, Y.idf(g, n), n)


@query(f"{_GRAMS} SELECT account_id, gram, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY ALL")
def ngram_counts(spark, d):
    return _counts(spark, d).select("account_id", "gram", "n")


@query(f"{_GRAMS} SELECT gram, count(*) AS df FROM g GROUP BY ALL")
def ngram_df(spark, d):
    return _counts(spark, d).groupBy("gram").agg(F.sum("df").alias("df"))


@query(f"{_GRAMS}, {_IDF} SELECT gram, df, round(idf + 1e-9, 6) AS idf FROM i")
def ngram_idf(spark, d):
    return Y.idf(_counts(spark, d), A.documents(spark, d).count()).select("gram", "df", r("idf").alias("idf"))


@query(f"{_GRAMS}, {_IDF}, {_TFIDF}, k AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY round(w, 9) DESC, gram) AS k FROM u) SELECT account_id, gram, round(w + 1e-9, 6) AS w FROM k WHERE k <= 10")
def tfidf_top(spark, d):
    k = F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc(F.round("w", 9)), "idx"))
    return _tfidf(spark, d).withColumn("k", k).filter("k <= 10").select("account_id", F.col("idx").alias("gram"), r("w").alias("w"))


_SOURCE_PAIRS = "(SELECT DISTINCT x.source AS a, y.source AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1 WHERE x.source <> y.source)"


def _source_pairs(spark, d) -> DataFrame:
    """Sources of documents that follow each other."""
    own = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("source").alias("a"))
    following = own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return own.join(following, "doc_id").filter("a <> b").select("a", "b").distinct()


@query(f"{_GRAMS}, {_IDF}, {_TFIDF} SELECT pl.a, pl.b, round(sum(p.w * q.w) + 1e-9, 5) AS cosine FROM {_SOURCE_PAIRS} pl JOIN u p ON p.account_id = pl.a JOIN u q ON q.account_id = pl.b AND q.gram = p.gram GROUP BY pl.a, pl.b")
def ngram_cosine(spark, d):
    return V.pair_cosine(_source_pairs(spark, d), _tfidf(spark, d)).select("a", "b", r("cosine", 5).alias("cosine"))


@query()
def hashed_ngram_vector(spark, d):
    m = A.documents(spark, d)
    g, n = Y.account_hashed_grams(m), m.count()
    return Y.tfidf(g, Y.idf(g, n, "bucket"), n, "bucket").select("account_id", F.col("idx").alias("bucket"), r("w").alias("w"))


@query()
def stylometry_scores(spark, d):
    m = A.documents(spark, d)
    rows = Y.style_vectors(m, WORDS)
    return V.pair_cosine(_source_pairs(spark, d), rows).select("a", "b", r("cosine", 5).alias("cosine"))
