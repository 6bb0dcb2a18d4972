"""The catalogue's second half: temporal features, semantic pooling, calibration, metrics, baselines and the shortlist."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import compare as cmp
from ..session import kept, scratch_folder
from .catalogue import EV, SES12, SMALL, WORDS, A, B, C, E, K, P, S, V, X, Y, _ev, _k, _rounded, query, r

TAU = "6.283185307179586e0"
E_SQL = f"{SES12}, e AS (SELECT account_id, session, seq, t, len FROM ses)"


def _wave_sql(k, period, shift, p, t="t"):
    a = f"{2 * math.pi * k!r} * ({t} + {float(shift)!r}) / {float(period)!r}"
    return f"avg(cos({a})) AS {p}{k}_cos, avg(sin({a})) AS {p}{k}_sin"


def _harmonic_sql(ks, period, shift, p):
    inner = ", ".join(_wave_sql(k, period, shift, p) for k in ks)
    outer = ", ".join(f"round({p}{k}_cos + 1e-9, 6) AS {p}{k}_cos, round({p}{k}_sin + 1e-9, 6) AS {p}{k}_sin, round(sqrt({p}{k}_cos * {p}{k}_cos + {p}{k}_sin * {p}{k}_sin) + 1e-9, 6) AS {p}{k}_len" for k in ks)
    return f"{E_SQL}, h AS (SELECT account_id, {inner} FROM e GROUP BY ALL) SELECT account_id, {outer} FROM h"


@query(_harmonic_sql((1, 2, 3, 4, 6), 86400, 0, "d"))
def chrono_daily(spark, d):
    return _rounded(K.daily(_k(spark, d)))


@query(_harmonic_sql((1, 2, 3), 604800, 259200, "w"))
def chrono_weekly(spark, d):
    return _rounded(K.weekly(_k(spark, d)))


_SMOOTH = f"""{E_SQL}, b AS (SELECT account_id, CAST(floor((t - 86400 * floor(t / 86400)) / 1800) AS INTEGER) AS b, count(*) AS n FROM e GROUP BY ALL),
i48 AS (SELECT CAST(unnest(range(48)) AS INTEGER) AS i), raw AS (SELECT account_id, i, sum(n * exp(-0.5 * least(abs(b - i), 48 - abs(b - i)) * least(abs(b - i), 48 - abs(b - i)))) AS x FROM b CROSS JOIN i48 GROUP BY ALL),
sm AS (SELECT account_id, i, x / sum(x) OVER (PARTITION BY account_id) AS v FROM raw)"""


@query(f"{_SMOOTH} SELECT account_id, i AS bin, round(v + 1e-9, 7) AS value FROM sm")
def chrono_smoothed(spark, d):
    return K.smoothed(_k(spark, d)).select("account_id", F.posexplode("bins").alias("bin", "value")).select("account_id", "bin", r("value", 7).alias("value"))


_RHYTHM = f"""{_SMOOTH}, en AS (SELECT account_id, -sum(CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END) AS entropy, sum(v * cos({TAU} * (i + 0.5) / 48)) AS re, sum(v * sin({TAU} * (i + 0.5) / 48)) AS im FROM sm GROUP BY ALL),
o12 AS (SELECT CAST(unnest(range(12)) AS INTEGER) AS o), ms AS (SELECT s.account_id, i48.i AS s, sum(s.v) AS m FROM i48 CROSS JOIN o12 JOIN sm s ON s.i = (i48.i + o12.o) % 48 GROUP BY ALL),
lo AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY round(m, 12), s) AS k FROM ms)"""


@query(f"{_RHYTHM} SELECT account_id, round(entropy + 1e-9, 6) AS entropy, round(least(1.0, greatest(0.0, 1 - sqrt(re * re + im * im))) + 1e-9, 6) AS circular_variance FROM en")
def chrono_entropy(spark, d):
    return _rounded(K.rhythm(K.smoothed(_k(spark, d))).select("account_id", "entropy", "circular_variance"))


@query(f"{_RHYTHM} SELECT account_id, round(cos({TAU} * ((s + 6) % 48) / 48) + 1e-9, 6) AS trough_cos, round(sin({TAU} * ((s + 6) % 48) / 48) + 1e-9, 6) AS trough_sin, round(m + 1e-9, 6) AS trough_mass FROM lo WHERE k = 1")
def chrono_trough(spark, d):
    return _rounded(K.rhythm(K.smoothed(_k(spark, d))).select("account_id", "trough_cos", "trough_sin", "trough_mass"))


_WEEKEND = f"""{E_SQL}, wd AS (SELECT account_id, t, CAST(floor((t + 259200) / 86400) AS BIGINT) % 7 >= 5 AS off FROM e),
wk AS (SELECT account_id, avg(CAST(off AS INTEGER)) AS share, avg(CASE WHEN NOT off THEN cos({TAU} * t / 86400) END) AS ac, avg(CASE WHEN NOT off THEN sin({TAU} * t / 86400) END) AS as_,
 avg(CASE WHEN off THEN cos({TAU} * t / 86400) END) AS bc, avg(CASE WHEN off THEN sin({TAU} * t / 86400) END) AS bs FROM wd GROUP BY ALL)"""
_PHASE = "CASE WHEN sqrt(ac * ac + as_ * as_) > 1e-9 AND sqrt(bc * bc + bs * bs) > 1e-9 THEN least(1.0, greatest(-1.0, (bc * ac + bs * as_) / (sqrt(ac * ac + as_ * as_) * sqrt(bc * bc + bs * bs)))) ELSE 0 END"


@query(f"{_WEEKEND} SELECT account_id, round(share + 1e-9, 6) AS weekend_share, round({_PHASE} + 1e-9, 6) AS weekend_phase FROM wk")
def chrono_weekend(spark, d):
    return _rounded(K.weekend(_k(spark, d)))


_GAPS = f"""{E_SQL}, ig AS (SELECT account_id, session, seq, len, least(1800.0, greatest(0.5, t - lag(t) OVER (PARTITION BY account_id, session ORDER BY seq))) AS gap,
 lag(t) OVER (PARTITION BY account_id, session ORDER BY seq) AS p FROM e), gi0 AS (SELECT * FROM ig WHERE p IS NOT NULL),
gi AS (SELECT *, lag(gap) OVER (PARTITION BY account_id, session ORDER BY seq) AS before FROM gi0),
wo AS (SELECT account_id, least(1800.0, greatest(0.5, t - lag(t) OVER (PARTITION BY account_id ORDER BY seq))) AS gap, lag(t) OVER (PARTITION BY account_id ORDER BY seq) AS p, count(*) OVER (PARTITION BY account_id) AS n FROM e WHERE account_id NOT IN (SELECT account_id FROM gi)),
iv AS (SELECT account_id, gap FROM gi UNION ALL SELECT account_id, CASE WHEN p IS NULL THEN 1800.0 ELSE gap END FROM wo WHERE p IS NOT NULL OR n = 1),
tau AS (SELECT account_id, gap, ln(1 + gap) AS tau FROM iv)"""
_HIST = ", ".join(f"round(count(CASE WHEN least(15, CAST(floor(tau * 16 / {math.log(1801.0)!r}) AS INTEGER)) = {i} THEN 1 END) / count(*) + 1e-9, 6) AS gap_h{i}" for i in range(16))


def _burst(spark, d):
    e = _k(spark, d)
    return K.burst(K.intervals(e, K.gaps(e)))


@query(f"{_GAPS} SELECT account_id, {_HIST} FROM tau GROUP BY ALL")
def chrono_gap_hist(spark, d):
    return _rounded(_burst(spark, d).select("account_id", *[f"gap_h{i}" for i in range(16)]))


_MOMENTS = "mo0 AS (SELECT account_id, avg(tau) AS mu, stddev_pop(tau) AS sd FROM tau GROUP BY ALL), mo AS (SELECT m.account_id, mu, CASE WHEN sd < 1e-12 THEN 0 ELSE sd END AS sd, CASE WHEN sd < 1e-12 THEN 0 ELSE avg(((tau - mu) / sd) ^ 3) END AS sk, CASE WHEN sd < 1e-12 THEN 0 ELSE avg(((tau - mu) / sd) ^ 4) - 3 END AS ku FROM tau JOIN mo0 m USING (account_id) GROUP BY m.account_id, mu, sd)"


@query(f"{_GAPS}, {_MOMENTS} SELECT account_id, round(mu + 1e-9, 6) AS tau_mean, round(sd + 1e-9, 6) AS tau_std, round(sk + 1e-9, 5) AS tau_skew, round(ku + 1e-9, 5) AS tau_kurtosis FROM mo")
def chrono_gap_moments(spark, d):
    return _burst(spark, d).select("account_id", r("tau_mean").alias("tau_mean"), r("tau_std").alias("tau_std"), r("tau_skew", 5).alias("tau_skew"), r("tau_kurtosis", 5).alias("tau_kurtosis"))


@query(f"{_GAPS} SELECT account_id, round(quantile_cont(tau, 0.1) + 1e-9, 6) AS tau_q10, round(quantile_cont(tau, 0.5) + 1e-9, 6) AS tau_q50, round(quantile_cont(tau, 0.9) + 1e-9, 6) AS tau_q90 FROM tau GROUP BY ALL")
def chrono_gap_quantiles(spark, d):
    return _rounded(_burst(spark, d).select("account_id", "tau_q10", "tau_q50", "tau_q90"))


@query(f"{_GAPS} SELECT account_id, round((stddev_pop(gap) - avg(gap)) / (stddev_pop(gap) + avg(gap)) + 1e-9, 6) AS dispersion FROM tau GROUP BY ALL")
def chrono_dispersion(spark, d):
    return _rounded(_burst(spark, d).select("account_id", "dispersion"))


def _corr_sql(x, y, least):
    return f"CASE WHEN count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) >= {least} AND stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) >= 1e-12 AND stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END) >= 1e-12 THEN least(1.0, greatest(-1.0, covar_pop({x}, {y}) / (stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END)))) ELSE 0 END"


@query(f"{_GAPS} SELECT account_id, round({_corr_sql('before', 'gap', 3)} + 1e-9, 6) AS memory FROM gi GROUP BY ALL")
def chrono_memory(spark, d):
    return _rounded(K.memory(K.gaps(_k(spark, d))))


_FANO = f"""{E_SQL}, fl AS (SELECT *, min(t) OVER w AS f, max(t) OVER w AS l FROM e WINDOW w AS (PARTITION BY account_id, session)), ws AS (SELECT unnest([60, 300, 900, 1800]) AS width),
fw AS (SELECT account_id, session, width, t, f, CAST(greatest(1, ceil((l - f) / width)) AS BIGINT) AS windows FROM fl CROSS JOIN ws), fc AS (SELECT account_id, session, width, windows, least(windows - 1, CAST(floor((t - f) / width) AS BIGINT)) AS at, count(*) AS n FROM fw GROUP BY ALL),
fs AS (SELECT account_id, session, width, windows, sum(n) AS n, sum(n * n) AS n2 FROM fc GROUP BY ALL), fa AS (SELECT account_id, width, CAST(sum(windows) AS DOUBLE) AS w, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n2) AS DOUBLE) AS n2 FROM fs GROUP BY ALL),
fano AS (SELECT account_id, width, ln(1 + greatest(0.0, n2 / w - (n / w) * (n / w)) / greatest(1e-9, n / w)) AS fano FROM fa)"""


@query(f"{_FANO} SELECT account_id, width, round(fano + 1e-9, 6) AS fano FROM fano")
def chrono_fano(spark, d):
    return _rounded(K.fano(_k(spark, d)))


_VEL = f"{_GAPS}, vl AS (SELECT account_id, CASE WHEN gap <= 120 THEN len / greatest(1.0, gap) END AS v, ln(1 + len) AS ll, ln(1 + gap) AS lg FROM gi)"


@query(f"{_VEL} SELECT account_id, round(coalesce(avg(v), 0) + 1e-9, 6) AS v_mean, round(coalesce(stddev_pop(v), 0) + 1e-9, 6) AS v_std, round(coalesce(quantile_cont(v, 0.5), 0) + 1e-9, 6) AS v_q50, round(coalesce(quantile_cont(v, 0.9), 0) + 1e-9, 6) AS v_q90 FROM vl GROUP BY ALL")
def chrono_velocity(spark, d):
    return _rounded(K.lengths_and_gaps(K.gaps(_k(spark, d))).drop("length_corr"))


@query(f"{_VEL} SELECT account_id, round({_corr_sql('ll', 'lg', 2)} + 1e-9, 6) AS length_corr FROM vl GROUP BY ALL")
def chrono_len_corr(spark, d):
    return _rounded(K.lengths_and_gaps(K.gaps(_k(spark, d))).select("account_id", "length_corr"))


_SHAPE = f"{E_SQL}, s AS (SELECT account_id, session, count(*) AS n, min(t) AS a, max(t) AS b FROM e GROUP BY ALL)"


@query(f"{_SHAPE} SELECT account_id, round(ln(1 + avg(n)) + 1e-9, 6) AS size, round(stddev_pop(n) / avg(n) + 1e-9, 6) AS size_cv, round(ln(1 + avg(b - a)) + 1e-9, 6) AS duration, round(stddev_pop(ln(1 + b - a)) + 1e-9, 6) AS duration_std, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS singletons FROM s GROUP BY ALL")
def chrono_session_summary(spark, d):
    return _rounded(K.session_shape(_k(spark, d)).select("account_id", "size", "size_cv", "duration", "duration_std", "singletons"))


@query(f"{_SHAPE} SELECT account_id, " + ", ".join(f"round(avg({f}({TAU} * {x} / 86400)) + 1e-9, 6) AS {n}_{f}" for x, n in (("a", "start"), ("b", "end")) for f in ("cos", "sin")) + " FROM s GROUP BY ALL")
def chrono_endpoints(spark, d):
    return _rounded(K.session_shape(_k(spark, d)).select("account_id", "start_cos", "start_sin", "end_cos", "end_sin"))


# All 122 features, in long form: every block above without rounding.
def _unpivot(src, columns, first):
    return " UNION ALL ".join(f"SELECT account_id, {first + i} AS idx, CAST({c} AS DOUBLE) AS value FROM {src}" for i, c in enumerate(columns))


def _features_sql() -> str:
    head = E_SQL
    body = [
        "hd AS (SELECT account_id, " + ", ".join(_wave_sql(k, 86400, 0, "d") for k in (1, 2, 3, 4, 6)) + " FROM e GROUP BY ALL)",
        "hw AS (SELECT account_id, " + ", ".join(_wave_sql(k, 604800, 259200, "w") for k in (1, 2, 3)) + " FROM e GROUP BY ALL)",
    ]
    base = len(E_SQL)
    body += [_RHYTHM[base + 2 :], _WEEKEND[base + 2 :], _VEL[base + 2 :], _MOMENTS, _FANO[base + 2 :], _SHAPE[base + 2 :]]
    hist = ", ".join(x.replace("round(", "(").replace(" + 1e-9, 6)", ")") for x in _HIST.split(", round(") for x in [x if x.startswith("round(") else "round(" + x])
    body += [
        f"hg AS (SELECT account_id, {hist} FROM tau GROUP BY ALL)",
        "qt AS (SELECT account_id, quantile_cont(tau, 0.1) AS q1, quantile_cont(tau, 0.5) AS q5, quantile_cont(tau, 0.9) AS q9, (stddev_pop(gap) - avg(gap)) / (stddev_pop(gap) + avg(gap)) AS disp FROM tau GROUP BY ALL)",
        f"me AS (SELECT account_id, {_corr_sql('before', 'gap', 3)} AS memory FROM gi GROUP BY ALL)",
        f"ve AS (SELECT account_id, coalesce(avg(v), 0) AS m, coalesce(stddev_pop(v), 0) AS s, coalesce(quantile_cont(v, 0.5), 0) AS q5, coalesce(quantile_cont(v, 0.9), 0) AS q9, {_corr_sql('ll', 'lg', 2)} AS lc FROM vl GROUP BY ALL)",
        "sh AS (SELECT account_id, ln(1 + avg(n)) AS a1, stddev_pop(n) / avg(n) AS a2, ln(1 + avg(b - a)) AS a3, stddev_pop(ln(1 + b - a)) AS a4, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END) AS a5, "
        + ", ".join(f"avg({f}({TAU} * {x} / 86400)) AS {x}{f}" for x in "ab" for f in ("cos", "sin")) + " FROM s GROUP BY ALL)",
        "ac AS (SELECT DISTINCT account_id FROM e)", "me2 AS (SELECT ac.account_id, coalesce(memory, 0) AS memory FROM ac LEFT JOIN me USING (account_id))",
        "ve2 AS (SELECT ac.account_id, coalesce(m, 0) AS m, coalesce(s, 0) AS s, coalesce(q5, 0) AS q5, coalesce(q9, 0) AS q9, coalesce(lc, 0) AS lc FROM ac LEFT JOIN ve USING (account_id))",
        "tr AS (SELECT account_id, cos(2 * pi() * ((s + 6) % 48) / 48) AS c, sin(2 * pi() * ((s + 6) % 48) / 48) AS n, m FROM lo WHERE k = 1)",
    ]
    wave = lambda p, ks: [x for k in ks for x in (f"{p}{k}_cos", f"{p}{k}_sin", f"sqrt({p}{k}_cos * {p}{k}_cos + {p}{k}_sin * {p}{k}_sin)")]
    parts = [
        _unpivot("hd", wave("d", (1, 2, 3, 4, 6)), 0), _unpivot("hw", wave("w", (1, 2, 3)), 15), "SELECT account_id, 24 + i AS idx, v AS value FROM sm",
        _unpivot("en", ["entropy", "least(1.0, greatest(0.0, 1 - sqrt(re * re + im * im)))"], 72), _unpivot("tr", ["c", "n", "m"], 74), _unpivot("wk", ["share", _PHASE], 77),
        _unpivot("hg", [f"gap_h{i}" for i in range(16)], 79), _unpivot("mo", ["mu", "sd", "sk", "ku"], 95), _unpivot("qt", ["q1", "q5", "q9", "disp"], 99), _unpivot("me2", ["memory"], 103),
        "SELECT account_id, 104 + CASE width WHEN 60 THEN 0 WHEN 300 THEN 1 WHEN 900 THEN 2 ELSE 3 END AS idx, fano AS value FROM fano", _unpivot("ve2", ["m", "s", "q5", "q9", "lc"], 108),
        _unpivot("sh", ["a1", "a2", "a3", "a4", "a5", "acos", "asin", "bcos", "bsin"], 113),
    ]
    return f"{head}, {', '.join(body)}, feat AS ({' UNION ALL '.join(parts)})"


FEATURES = _features_sql()
_VECTOR = """st AS (SELECT idx, avg(value) AS m, stddev_pop(value) AS s FROM feat GROUP BY ALL), z AS (SELECT account_id, f.idx, CASE WHEN f.idx < 79 THEN 0 WHEN f.idx < 108 THEN 1 ELSE 2 END AS block, CASE WHEN s = 0 THEN 0 ELSE (value - m) / s END AS z FROM feat f JOIN st ON f.idx = st.idx),
zb AS (SELECT account_id, idx, block, z, sqrt(sum(z * z) OVER (PARTITION BY account_id, block)) AS n FROM z), u AS (SELECT account_id, idx, CASE WHEN n > 0 THEN z / n ELSE 0 END * CASE block WHEN 0 THEN 0.45 WHEN 1 THEN 0.30 ELSE 0.25 END AS u FROM zb),
vec AS (SELECT account_id, idx, u / sqrt(sum(u * u) OVER (PARTITION BY account_id)) AS w FROM u)"""
#: The pairs that queries ask for: every account with those of the next five ids.
PAIR_LIST = "pl AS (SELECT x.account_id AS a, y.account_id AS b FROM (SELECT account_id, CAST(account_id AS BIGINT) + unnest([1, 2, 3, 4, 5]) AS other FROM (SELECT DISTINCT account_id FROM acc)) x JOIN (SELECT DISTINCT account_id FROM acc) y ON CAST(y.account_id AS BIGINT) = x.other)"
_PAIRS = f"""{PAIR_LIST}, pr AS (SELECT pl.a, pl.b, least(1.0, greatest(-1.0, sum(p.w * q.w))) AS cosine FROM pl JOIN vec p ON p.account_id = pl.a JOIN vec q ON q.account_id = pl.b AND q.idx = p.idx GROUP BY pl.a, pl.b)"""


def _features(spark, d):
    # Ten blocks read the events; they are kept, so that sessions are found once.
    return K.features(kept(_k(spark, d), "sessions"))


@query(f"{FEATURES} SELECT account_id, CAST(idx AS INTEGER) AS idx, round(value + 1e-9, 5) AS value FROM feat")
def chrono_features_all(spark, d):
    return _features(spark, d).select("account_id", "idx", r("value", 5).alias("value"))


@query(f"{FEATURES} SELECT CAST(idx AS INTEGER) AS idx, round(avg(value) + 1e-9, 5) AS mean, round(stddev_pop(value) + 1e-9, 5) AS std FROM feat GROUP BY ALL")
def chrono_fit(spark, d):
    f = K.fit(_features(spark, d))
    return f.select("idx", r("mean", 5).alias("mean"), r("std", 5).alias("std"))


def _vectors(spark, d) -> DataFrame:
    f = kept(_features(spark, d), "features")
    return K.vectors(f, K.fit(f))


@query(f"{FEATURES}, {_VECTOR} SELECT account_id, CAST(idx AS INTEGER) AS idx, CASE WHEN round(w + 1e-9, 4) = 0 THEN 0.0 ELSE round(w + 1e-9, 4) END AS w FROM vec")
def chrono_vector(spark, d):
    w = r("w", 4)
    return _vectors(spark, d).select("account_id", "idx", F.when(w == 0, 0.0).otherwise(w).alias("w"))


def _pair_list(spark, d):
    """Every account with those of the next five ids: five pairs an account at most, by an equal join."""
    accounts = P.accept(_ev(spark, d)).select("account_id").distinct()
    wanted = accounts.select(F.col("account_id").alias("a"), F.explode(F.array(*[(F.col("account_id").cast("long") + k).cast("string") for k in range(1, 6)])).alias("b"))
    return wanted.join(accounts.withColumnRenamed("account_id", "b"), "b", "left_semi").select("a", "b")


def _cosines(spark, d):
    return V.pair_cosine(_pair_list(spark, d), _vectors(spark, d))


@query(f"{FEATURES}, {_VECTOR}, {_PAIRS} SELECT a, b, round(cosine + 1e-9, 5) AS cosine FROM pr")
def chrono_pair_cosine(spark, d):
    return _cosines(spark, d).select("a", "b", r("cosine", 5).alias("cosine"))


# Calibration uses cosines rounded to 5 places on both sides, so that equal values stay equal.
_CAL = f"{FEATURES}, {_VECTOR}, {_PAIRS}, q AS (SELECT a, b, round(cosine + 1e-9, 5) AS cosine FROM pr), base AS (SELECT cosine FROM q WHERE (CAST(a AS BIGINT) + CAST(b AS BIGINT)) % 2 = 0), cal AS (SELECT a, b, cosine, 100.0 * (SELECT count(*) FROM base WHERE base.cosine <= q.cosine) / (SELECT count(*) FROM base) AS percentile FROM q)"


def _calibrated(spark, d):
    # Kept: the query reads the cosines three times, and sums computed anew may end on the other side of a rounding.
    q = kept(_cosines(spark, d).select("a", "b", r("cosine", 5).alias("cosine")), "cosines")
    base = q.filter("(CAST(a AS BIGINT) + CAST(b AS BIGINT)) % 2 = 0")
    return C.percentile(base, q)


@query(f"{_CAL} SELECT a, b, round(percentile + 1e-9, 6) AS percentile FROM cal")
def calibrate_percentile(spark, d):
    return _calibrated(spark, d).select("a", "b", r("percentile").alias("percentile"))


@query(f"{FEATURES}, {_VECTOR}, {_PAIRS} SELECT round(cosine + 1e-9, 5) AS cosine, count(*) AS n FROM pr GROUP BY ALL")
def baseline_distribution(spark, d):
    return _cosines(spark, d).select(r("cosine", 5).alias("cosine")).groupBy("cosine").agg(F.count("*").alias("n"))


# Fusion over the events as made-up engine results: percentiles from value, statuses from ids.
_FUSE_ROWS = "fr AS (SELECT event_id AS a, CASE event_id % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'INSUFFICIENT_DATA' WHEN 2 THEN 'TIMEOUT' ELSE 'ERROR' END AS s1, CASE (event_id // 4) % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'INSUFFICIENT_DATA' WHEN 2 THEN 'TIMEOUT' ELSE 'ERROR' END AS s2, CASE (event_id // 16) % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'INSUFFICIENT_DATA' WHEN 2 THEN 'TIMEOUT' ELSE 'ERROR' END AS s3, least(100.0, value % 101) AS p1, least(100.0, (value * 3) % 101) AS p2, least(100.0, (value * 7) % 101) AS p3 FROM events)"


def _fuse_rows(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    status = lambda k: F.when(k % 4 == 0, "OK").when(k % 4 == 1, "INSUFFICIENT_DATA").when(k % 4 == 2, "TIMEOUT").otherwise("ERROR")
    cols = []
    for i, (name, m) in enumerate(zip(C.ENGINES, (1, 3, 7))):
        s = status(F.floor(F.col("event_id") / 4**i))
        p = F.least(F.lit(100.0), (F.col("value") * m) % 101)
        cols += [s.alias(f"{name}_status"), F.when(s == "OK", p).alias(f"{name}_percentile"), F.when(s == "INSUFFICIENT_DATA", "MINIMUMS_NOT_MET").when(s == "TIMEOUT", "ENGINE_TIMEOUT").when(s == "ERROR", "ENGINE_FAILURE").alias(f"{name}_error")]
    return C.fuse(e.select(F.col("event_id").alias("a"), *cols))


_W = [("s1", "p1", 0.4), ("s2", "p2", 0.35), ("s3", "p3", 0.25)]
_SUMW = " + ".join(f"CASE WHEN {s} = 'OK' THEN {w} ELSE 0 END" for s, _, w in _W)
_PLAIN = "(" + " + ".join(f"CASE WHEN {s} = 'OK' THEN {w} * {p} ELSE 0 END" for s, p, w in _W) + f") / nullif({_SUMW}, 0)"
_EVID = "(" + " + ".join(f"CASE WHEN {s} = 'OK' THEN {w} * -ln(greatest(0.0005, 1 - {p} / 100 + 0.0005)) ELSE 0 END" for s, p, w in _W) + f") / nullif({_SUMW}, 0)"
_FUSED = f"{_FUSE_ROWS}, fp AS (SELECT *, {_PLAIN} AS plain, {_EVID} AS ev FROM fr), ft AS (SELECT *, 100 * least(1.0, greatest(0.0, 1.0005 - exp(-ev))) AS tail FROM fp)"


@query(f"WITH {_FUSED} SELECT a, round(plain + 1e-9, 6) AS weighted_percentile, round(tail + 1e-9, 6) AS fisher_tail_score, round(0.5 * plain + 0.5 * tail + 1e-9, 6) AS combined_score FROM ft WHERE 'OK' IN (s1, s2, s3)")
def fuse_scores(spark, d):
    f = _fuse_rows(spark, d).filter("status = 'OK'")
    return f.select("a", *[r(c).alias(c) for c in ("weighted_percentile", "fisher_tail_score", "combined_score")])


_ERR = " ".join(f"WHEN {s} = 'INSUFFICIENT_DATA' THEN 'MINIMUMS_NOT_MET' WHEN {s} = 'TIMEOUT' THEN 'ENGINE_TIMEOUT' WHEN {s} = 'ERROR' THEN 'ENGINE_FAILURE'" for s in ("s1",))


@query(f"""WITH {_FUSE_ROWS} SELECT a, CASE WHEN 'OK' IN (s1, s2, s3) THEN 'OK' WHEN s1 = 'INSUFFICIENT_DATA' AND s2 = s1 AND s3 = s1 THEN 'INSUFFICIENT_DATA' WHEN 'TIMEOUT' IN (s1, s2, s3) THEN 'TIMEOUT' ELSE 'ERROR' END AS status,
CASE WHEN 'OK' IN (s1, s2, s3) THEN NULL WHEN s1 = 'INSUFFICIENT_DATA' AND s2 = s1 AND s3 = s1 THEN 'MINIMUMS_NOT_MET' WHEN 'TIMEOUT' IN (s1, s2, s3) THEN 'ENGINE_TIMEOUT' ELSE CASE {_ERR} END END AS error,
concat_ws(',', CASE WHEN s1 = 'OK' THEN 'stylometry' END, CASE WHEN s2 = 'OK' THEN 'semantic' END, CASE WHEN s3 = 'OK' THEN 'chronobiology' END) AS active_engines FROM fr""")
def fuse_failure_precedence(spark, d):
    return _fuse_rows(spark, d).select("a", "status", "error", "active_engines")


# Metrics over labelled documents: score is the length in thousands of characters, capped at 100.
_LAB = "lab AS (SELECT least(100.0, round(d.n_chars / 100.0, 1)) AS score, l.quality = 1 AS y FROM labels l JOIN documents d USING (doc_id))"


def _lab(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars")
    score = F.least(F.lit(100.0), F.round(F.col("n_chars") / 100.0, 1))
    return spark.read.parquet(f"{d}/labels.parquet").join(docs, "doc_id").select(score.alias("score"), (F.col("quality") == 1).alias("is_same"))


@query(f"WITH {_LAB}, k AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM lab), n AS (SELECT CAST(count(CASE WHEN y THEN 1 END) AS DOUBLE) AS p, CAST(count(CASE WHEN NOT y THEN 1 END) AS DOUBLE) AS q FROM lab) SELECT round((sum(CASE WHEN y THEN rk ELSE 0 END) - any_value(p) * (any_value(p) + 1) / 2) / (any_value(p) * any_value(q)) + 1e-9, 6) AS roc_auc FROM k, n")
def roc_auc(spark, d):
    return E.roc_auc(_lab(spark, d)).select(r("roc_auc").alias("roc_auc"))


@query(f"WITH {_LAB}, o AS (SELECT y, row_number() OVER (ORDER BY score DESC, NOT y) AS i, sum(CAST(y AS INTEGER)) OVER (ORDER BY score DESC, NOT y ROWS UNBOUNDED PRECEDING) AS tp FROM lab) SELECT round(sum(CASE WHEN y THEN tp / i ELSE 0 END) / sum(CAST(y AS INTEGER)) + 1e-9, 6) AS pr_auc FROM o")
def pr_auc(spark, d):
    return E.pr_auc(_lab(spark, d)).select(r("pr_auc").alias("pr_auc"))


@query(f"WITH {_LAB} SELECT round(count(CASE WHEN y AND score >= 20 THEN 1 END) / nullif(count(CASE WHEN score >= 20 THEN 1 END), 0) + 1e-9, 6) AS precision, round(count(CASE WHEN y AND score >= 20 THEN 1 END) / nullif(count(CASE WHEN y THEN 1 END), 0) + 1e-9, 6) AS recall FROM lab")
def precision_recall_at(spark, d):
    return _rounded(E.precision_recall(_lab(spark, d), 20.0))


@query(f"WITH {_LAB}, g AS (SELECT score, count(CASE WHEN y THEN 1 END) AS p, count(*) AS n FROM lab GROUP BY ALL), c AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS n, sum(p) OVER () AS pos FROM g WINDOW w AS (ORDER BY score DESC)), t AS (SELECT score, tp / n AS pr, tp / pos AS rc FROM c) SELECT score AS threshold, pr >= 0.8 AS met FROM t ORDER BY pr >= 0.8 DESC, rc DESC, pr DESC, score LIMIT 1")
def best_threshold(spark, d):
    return E.best_threshold(_lab(spark, d))


@query(f"WITH {_LAB} SELECT round(avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS base_rate, count(CASE WHEN y THEN 1 END) AS support_same, count(CASE WHEN NOT y THEN 1 END) AS support_different FROM lab")
def base_rate(spark, d):
    return _rounded(E.base_rate(_lab(spark, d)))


@query()
def bootstrap_ci(spark, d):
    return _rounded(E.bootstrap(_lab(spark, d), 20.0))


@query()
def evaluation_report(spark, d):
    rows = _lab(spark, d)
    t = E.best_threshold(rows)
    one = t.crossJoin(E.roc_auc(rows)).crossJoin(E.pr_auc(rows)).crossJoin(E.base_rate(rows))
    return _rounded(one.withColumn("engine", F.lit("combined")))


# Pairs, components, strata -------------------------------------------------------------------------

# Customers, their orders, and the orders' suppliers' parts would be one component; customers and orders alone are many.
_EDGES = "ed AS (SELECT DISTINCT o_custkey AS a, 1000000000 + o_orderkey AS b FROM orders)"


def _edges(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_custkey").cast("long").alias("a"), (F.lit(1_000_000_000).cast("long") + F.col("o_orderkey")).alias("b")).distinct()


def _components(spark, d):
    e = _edges(spark, d)
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    return E.same_components(e, nodes, scratch_folder(spark, "same"))


@query(f"WITH RECURSIVE {_EDGES}, sy AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), re AS (SELECT DISTINCT a AS node, a AS r FROM sy UNION SELECT sy.b, re.r FROM re JOIN sy ON sy.a = re.node) SELECT node, min(r) AS component FROM re GROUP BY ALL")
def same_components(spark, d):
    return _components(spark, d)


@query()
def account_split(spark, d):
    return E.split_components(_components(spark, d))


@query("SELECT DISTINCT least(o_custkey, o_orderkey % 1000) AS a, greatest(o_custkey, o_orderkey % 1000) AS b FROM orders WHERE o_custkey <> o_orderkey % 1000")
def pair_canonicalize(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 1000).alias("b"), F.lit("different").alias("label")).filter("a <> b")
    return B.canonical_pairs(o)[0].select("a", "b")


@query("SELECT least(o_custkey, o_orderkey % 100) AS a, greatest(o_custkey, o_orderkey % 100) AS b FROM orders WHERE o_custkey <> o_orderkey % 100 GROUP BY ALL HAVING count(DISTINCT o_orderstatus) > 1")
def label_conflicts(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 100).alias("b"), F.col("o_orderstatus").alias("label")).filter("a <> b")
    return B.canonical_pairs(o)[1]


_PF = f"""WITH {EV}, ct AS (SELECT account_id, count(*) AS n, sum(len) AS ch FROM acc GROUP BY ALL), rd AS (SELECT account_id FROM ct WHERE n >= 40 AND ch >= 500), {PAIR_LIST},
gm AS (SELECT account_id, game_id AS v, row_number() OVER (PARTITION BY account_id ORDER BY count(*) DESC, game_id) AS k FROM acc GROUP BY account_id, game_id), cm AS (SELECT account_id, channel_id AS v, row_number() OVER (PARTITION BY account_id ORDER BY count(*) DESC, channel_id) AS k FROM acc WHERE channel_id IS NOT NULL GROUP BY account_id, channel_id),
mo AS (SELECT DISTINCT account_id, strftime(make_timestamp(us), '%Y-%m') AS m FROM acc), p AS (SELECT rd.account_id, gm.v AS g, cm.v AS c FROM rd JOIN gm ON gm.account_id = rd.account_id AND gm.k = 1 LEFT JOIN cm ON cm.account_id = rd.account_id AND cm.k = 1),
sl AS (SELECT x.account_id AS a, y.account_id AS b, CASE WHEN x.g = y.g THEN 'same-game' ELSE 'cross-game' END || '|' || CASE WHEN x.c = y.c THEN 'same-channel' ELSE 'other-channel' END || '|' || CASE WHEN EXISTS (SELECT 1 FROM mo i JOIN mo j ON i.m = j.m WHERE i.account_id = x.account_id AND j.account_id = y.account_id) THEN 'same-month' ELSE 'other-month' END AS stratum FROM pl JOIN p x ON x.account_id = pl.a JOIN p y ON y.account_id = pl.b)"""


def _strata(spark, d):
    pairs = _pair_list(spark, d).withColumn("label", F.lit("different"))
    return B.eligible(pairs, P.profiles(_ev(spark, d), SMALL))


@query(f"{_PF} SELECT a, b, stratum FROM sl")
def strata_labels(spark, d):
    return _strata(spark, d)


@query(f"{_PF} SELECT stratum, count(*) AS n FROM sl GROUP BY ALL")
def strata_counts(spark, d):
    return _strata(spark, d).groupBy("stratum").agg(F.count("*").alias("n"))


@query(f"{_PF}, n AS (SELECT stratum, count(*) AS n FROM sl GROUP BY ALL), t AS (SELECT *, sum(n) OVER () AS al, least(100, sum(n) OVER ()) AS tot FROM n), f AS (SELECT *, (tot * n) // al AS base, (tot * n) % al AS rest FROM t), k AS (SELECT *, row_number() OVER (ORDER BY base < n DESC, rest DESC, stratum) AS k, tot - sum(base) OVER () AS remaining FROM f) SELECT stratum, n, CAST(base + CASE WHEN base < n AND k <= remaining THEN 1 ELSE 0 END AS BIGINT) AS take FROM k")
def largest_remainder_alloc(spark, d):
    return B.allocation(_strata(spark, d).groupBy("stratum").agg(F.count("*").alias("n")), 100)


@query()
def stratified_sample(spark, d):
    return B.sample(_strata(spark, d), 100)


@query(f"WITH {EV}, {PAIR_LIST}, m AS (SELECT account_id, list(DISTINCT strftime(make_timestamp(us), '%Y-%m')) AS months FROM acc GROUP BY ALL) SELECT pl.a, pl.b, list_has_any(x.months, y.months) AS overlap FROM pl JOIN m x ON x.account_id = pl.a JOIN m y ON y.account_id = pl.b")
def months_overlap(spark, d):
    m = P.accept(_ev(spark, d)).groupBy("account_id").agg(F.collect_set(F.date_format(F.timestamp_micros("us"), "yyyy-MM")).alias("months"))
    side = lambda s: m.select(F.col("account_id").alias(s), F.col("months").alias(f"m_{s}"))
    return _pair_list(spark, d).join(side("a"), "a").join(side("b"), "b").select("a", "b", F.arrays_overlap("m_a", "m_b").alias("overlap"))


# Semantic ------------------------------------------------------------------------------------------

_EMB = "WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS idx, unnest(embedding) AS v FROM embeddings), pool AS (SELECT label, idx, avg(CAST(v AS DOUBLE)) AS value FROM x GROUP BY ALL)"


def _pool(spark, d):
    return S.mean_pool(spark.read.parquet(f"{d}/embeddings.parquet"), "label", "embedding")


@query(f"{_EMB} SELECT label, CAST(idx AS INTEGER) AS idx, round(value + 1e-9, 6) AS value FROM pool")
def embed_mean_pool(spark, d):
    return _rounded(_pool(spark, d))


_CEN = f"{_EMB}, ce AS (SELECT label, idx, value - avg(value) OVER (PARTITION BY idx) AS value FROM pool)"


def _centred(spark, d):
    p = _pool(spark, d)
    return S.centred(p, p.groupBy("idx").agg(F.avg("value").alias("centre")))


@query(f"{_CEN} SELECT label, CAST(idx AS INTEGER) AS idx, round(value + 1e-9, 6) AS value FROM ce")
def embed_center(spark, d):
    return _rounded(_centred(spark, d).select("label", "idx", "value"))


def _unit(spark, d):
    return V.unit(_pool(spark, d).select(F.col("label").cast("string").alias("account_id"), "idx", F.col("value").alias("w")))


_UNIT = f"{_EMB}, un AS (SELECT CAST(label AS VARCHAR) AS account_id, idx, value / sqrt(sum(value * value) OVER (PARTITION BY label)) AS w FROM pool)"


@query(f"{_UNIT} SELECT account_id, CAST(idx AS INTEGER) AS idx, round(w + 1e-9, 5) AS w FROM un")
def embed_l2(spark, d):
    return _unit(spark, d).select("account_id", "idx", r("w", 5).alias("w"))


@query(f"{_UNIT} SELECT pl.a, pl.b, round(sum(p.w * q.w) + 1e-9, 5) AS cosine FROM (SELECT DISTINCT CAST(x.label AS VARCHAR) AS a, CAST(y.label AS VARCHAR) AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1 WHERE x.label <> y.label) pl JOIN un p ON p.account_id = pl.a JOIN un q ON q.account_id = pl.b AND q.idx = p.idx GROUP BY ALL")
def embed_pair_cosine(spark, d):
    u, e = _unit(spark, d), spark.read.parquet(f"{d}/embeddings.parquet")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("other"))
    pairs = e.join(following, "vec_id").filter("label <> other").select(F.col("label").cast("string").alias("a"), F.col("other").cast("string").alias("b")).distinct()
    return V.pair_cosine(pairs, u).select("a", "b", r("cosine", 5).alias("cosine"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))) + 1e-9, 4) AS cosine FROM embeddings")
def embed_dense_cosine(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    first = e.agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.crossJoin(F.broadcast(first)).select("vec_id", r(V.dense_cosine(F.col("embedding"), F.col("first")), 4).alias("cosine"))


VOCAB = {w: i for i, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz", *["##" + c for c in "abcdefghijklmnopqrstuvwxyz"], "th", "##th", "##er", "##on", "##en", "the", ",", "."])}


def _windows(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet")
    return S.window_rows(c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text"), VOCAB, 64)


@query()
def wordpiece_windows(spark, d):
    return _windows(spark, d).select("id", "window", F.length("text").alias("n_chars"), F.size("ids").alias("n_pieces"), "key")


@query()
def synthetic_embed(spark, d):
    e, _ = S.embed(_windows(spark, d), S.SyntheticModel())
    return e.select("key", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


@query()
def embed_cache_hits(spark, d):
    w = _windows(spark, d)
    cache, _ = S.embed(w.filter("window = 0"), S.SyntheticModel())
    _, new = S.embed(w, S.SyntheticModel(), cache)
    return new.agg(F.count("*").alias("misses"))


# Comparison and evaluation -------------------------------------------------------------------------


def _engine_vectors(spark, d, accounts=None) -> dict[str, DataFrame]:
    """Each engine's vectors of all accounts of the events, fitted on those accounts (account_id) or on all."""
    messages = P.accept(_ev(spark, d))
    text = messages.select("account_id", X.mask_sql(F.col("text")).alias("text"))
    rows = S.window_rows(text, VOCAB, 64)
    vectors, _ = S.embed(rows, S.SyntheticModel())
    own = rows.select(F.col("id").alias("account_id"), "key").join(vectors, "key").select("account_id", "embedding")
    features = kept(_features(spark, d), "features")
    fitted = features if accounts is None else features.join(accounts.select("account_id").distinct(), "account_id", "left_semi")
    engines = {
        "stylometry": Y.style_vectors(messages, WORDS, fitted_on=accounts, gathered=True),
        "semantic": cmp.semantic_vectors(own, accounts),
        "chronobiology": K.vectors(features, K.fit(fitted)),
    }
    return {name: kept(v, name) for name, v in engines.items()}


def shortlist(spark, d) -> DataFrame:
    """Every listed pair compared by three engines against the listed pairs whose ids have an even sum, which are known to differ."""
    pairs = kept(_pair_list(spark, d), "pairs")
    least = (SMALL.minimum_messages, SMALL.minimum_chars)
    engines = []
    for name, vectors in _engine_vectors(spark, d).items():
        # All pairs' cosines are computed once; the baseline is a part of them.
        cosines = kept(V.pair_cosine(pairs, vectors), "cosines")
        base = cmp.Baseline(name, "all", cosines.filter("(CAST(a AS BIGINT) + CAST(b AS BIGINT)) % 2 = 0").select("cosine"), *least)
        engines.append(cmp.Engine(name, vectors, "all", base, *least, cosines=cosines))
    return cmp.compare(pairs, kept(P.profiles(_ev(spark, d), SMALL), "profiles"), engines)


@query()
def compare_shortlist(spark, d):
    return _rounded(shortlist(spark, d))


@query()
def evaluate_pipeline(spark, d):
    """Labels of the listed pairs: the same where ids differ by one and the lesser is a multiple of three."""
    same = (F.col("b").cast("long") - F.col("a").cast("long") == 1) & (F.col("a").cast("long") % 3 == 0)
    labelled = kept(_pair_list(spark, d), "pairs").select("a", "b", F.when(same, "same").otherwise("different").alias("label"))
    profiles = kept(P.profiles(_ev(spark, d), SMALL), "profiles")
    return _rounded(E.evaluate(labelled, profiles, lambda accounts: _engine_vectors(spark, d, accounts), scratch_folder(spark, "evaluate"), SMALL.minimum_messages, SMALL.minimum_chars))
