"""The 122 temporal features of an account, their fit, vectors and cosines.

Features are kept long: (account_id, idx, value). Every block is an aggregation over events
(account_id, session, seq, t, len), with t in seconds; none gathers an account's events in one task's memory
except exact quantiles, which Spark aggregates by distinct value.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import block_unit, fitted

TAU = 2 * math.pi
#: First index and size of the three blocks.
BLOCKS = ((0, 79), (79, 29), (108, 14))
_TINY = 1e-12


def events(sessioned: DataFrame) -> DataFrame:
    return sessioned.select("account_id", "session", "seq", (F.col("us") / 1e6).alias("t"), F.length("text").alias("len"))


def wave(t, k: int, period: float, shift: float = 0.0):
    """Mean cosine and sine of harmonic k, as aggregates."""
    angle = F.lit(TAU * k) * (t + F.lit(shift)) / F.lit(period)
    return F.avg(F.cos(angle)), F.avg(F.sin(angle))


def _long(wide: DataFrame, first: int, names: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(first + i).alias("idx"), F.col(n).cast("double").alias("value")) for i, n in enumerate(names)])
    return wide.select("account_id", F.explode(pairs).alias("p")).select("account_id", "p.idx", "p.value")


def daily(e: DataFrame) -> DataFrame:
    return _harmonics(e, (1, 2, 3, 4, 6), 86400.0, 0.0, "d")


def weekly(e: DataFrame) -> DataFrame:
    return _harmonics(e, (1, 2, 3), 604800.0, 259200.0, "w")


def _harmonics(e, ks, period, shift, p):
    aggs = []
    for k in ks:
        c, s = wave(F.col("t"), k, period, shift)
        aggs += [c.alias(f"{p}{k}_cos"), s.alias(f"{p}{k}_sin")]
    out = e.groupBy("account_id").agg(*aggs)
    for k in ks:
        out = out.withColumn(f"{p}{k}_len", F.hypot(f"{p}{k}_cos", f"{p}{k}_sin"))
    return out.select("account_id", *[f"{p}{k}_{x}" for k in ks for x in ("cos", "sin", "len")])


#: How half-hour j of the day adds to half-hour i: a circular Gaussian kernel.
KERNEL = np.array([[math.exp(-0.5 * min(abs(i - j), 48 - abs(i - j)) ** 2) for j in range(48)] for i in range(48)])


def smoothed(e: DataFrame) -> DataFrame:
    """(account_id, bins): 48 half-hour shares, smoothed by a circular Gaussian kernel and normalised.

    Batches of accounts pass through Arrow: as nested lambdas, the optimizer puts the whole of an expression in the
    place of each of its uses, within loops.
    """
    b = F.floor(F.pmod("t", F.lit(86400.0)) / 1800).cast("int")
    counts = e.select("account_id", b.alias("b")).groupBy("account_id").agg(F.array(*[F.count(F.when(F.col("b") == i, 1)) for i in range(48)]).alias("c"))

    def run(batches):
        for x in batches:
            c = x.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 48)
            raw = c.astype(float) @ KERNEL
            yield _batch(x.column(0), bins=raw / raw.sum(axis=1, keepdims=True))

    return counts.mapInArrow(run, counts.select("account_id", F.array(F.lit(0.0)).alias("bins")).schema)


def _batch(account, bins=None, **columns) -> pa.RecordBatch:
    """Arrow batch of the account, its bins where given, and columns of doubles."""
    own = {} if bins is None else {"bins": pa.ListArray.from_arrays(np.arange(0, bins.size + 1, 48, dtype=np.int32), pa.array(bins.ravel()))}
    own |= {k: pa.array(v) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([account, *own.values()], names=["account_id", *own])


def rhythm(smooth: DataFrame) -> DataFrame:
    """Entropy, circular variance and the quietest quarter of the day, from the smoothed bins."""
    names = ("entropy", "circular_variance", "trough_cos", "trough_sin", "trough_mass")
    angle = TAU * (np.arange(48) + 0.5) / 48
    quarter = (np.arange(48)[:, None] + np.arange(12)) % 48

    def run(batches):
        for x in batches:
            v = x.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 48)
            entropy = -(v * np.log(v, where=v > 0, out=np.zeros_like(v))).sum(axis=1)
            variance = np.clip(1 - np.hypot(v @ np.cos(angle), v @ np.sin(angle)), 0.0, 1.0)
            mass = v[:, quarter].sum(axis=2)
            s = np.round(mass, 12).argmin(axis=1)  # the first of equal ones
            a = TAU * ((s + 6) % 48) / 48
            yield _batch(x.column(0), **dict(zip(names, (entropy, variance, np.cos(a), np.sin(a), mass[np.arange(len(s)), s]))))

    rows = smooth.select("account_id", "bins")
    return rows.mapInArrow(run, rows.select("account_id", *[F.lit(0.0).alias(c) for c in names]).schema)


def weekend(e: DataFrame) -> DataFrame:
    """Share of weekend events, and how well the weekend's daily phase agrees with that of weekdays."""
    off = F.pmod(F.floor((F.col("t") + 259200) / 86400), F.lit(7)) >= 5
    angle = F.lit(TAU) * F.col("t") / 86400
    part = lambda f, c, n: F.avg(F.when(c, f(angle))).alias(n)
    g = e.groupBy("account_id").agg(F.avg(off.cast("double")).alias("weekend_share"), part(F.cos, ~off, "ac"), part(F.sin, ~off, "as_"), part(F.cos, off, "bc"), part(F.sin, off, "bs"))
    ra, rb = F.hypot("ac", "as_"), F.hypot("bc", "bs")
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(F.col("bc") * F.col("ac") + F.col("bs") * F.col("as_"), ra * rb)))
    return g.select("account_id", "weekend_share", F.when((ra > 1e-9) & (rb > 1e-9), cosine).otherwise(0.0).alias("weekend_phase"))


def _clamped(window):
    """Gap to the event before, between 0.5 and 1800 seconds; null at the first one (least and greatest skip nulls)."""
    gap = F.col("t") - F.lag("t").over(window)
    return F.when(gap.isNotNull(), F.least(F.lit(1800.0), F.greatest(F.lit(0.5), gap)))


def gaps(e: DataFrame) -> DataFrame:
    """Clamped gaps inside sessions: account_id, session, seq, gap, len, before (the gap before that)."""
    w = Window.partitionBy("account_id", "session").orderBy("seq")
    g = e.withColumn("gap", _clamped(w)).filter("gap IS NOT NULL")
    return g.withColumn("before", F.lag("gap").over(w)).select("account_id", "session", "seq", "gap", "len", "before")


def intervals(e: DataFrame, inside: DataFrame) -> DataFrame:
    """(account_id, gap): gaps inside sessions; of accounts without any, gaps between all events; of single events, 1800."""
    w = Window.partitionBy("account_id").orderBy("seq")
    without = e.join(inside.select("account_id").distinct(), "account_id", "left_anti")
    wide = without.withColumn("gap", _clamped(w)).withColumn("n", F.count("*").over(Window.partitionBy("account_id")))
    wide = wide.filter("gap IS NOT NULL OR n = 1").select("account_id", F.coalesce("gap", F.lit(1800.0)).alias("gap"))
    return inside.select("account_id", "gap").union(wide)


def burst(gap_rows: DataFrame) -> DataFrame:
    """Histogram, moments and quantiles of log1p gaps, and the dispersion of the gaps."""
    rows = gap_rows.withColumn("tau", F.log1p("gap"))
    top = math.log(1801.0)
    at = F.least(F.lit(15), F.floor(F.col("tau") * 16 / top).cast("int"))
    n = F.count("*")
    means = rows.groupBy("account_id").agg(F.avg("tau").alias("mu"), F.stddev_pop("tau").alias("sd"))
    hist = [(F.count(F.when(at == i, 1)) / n).alias(f"gap_h{i}") for i in range(16)]
    q = F.percentile("tau", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q")
    agg = rows.groupBy("account_id").agg(*hist, F.avg("tau").alias("tau_mean"), F.stddev_pop("tau").alias("sd"), F.skewness("tau").alias("sk"), F.kurtosis("tau").alias("ku"), q, F.avg("gap").alias("gm"), F.stddev_pop("gap").alias("gs"))
    flat = F.col("sd") < _TINY
    return agg.select(
        "account_id", *[f"gap_h{i}" for i in range(16)], "tau_mean", F.when(flat, 0.0).otherwise(F.col("sd")).alias("tau_std"), F.when(flat, 0.0).otherwise(F.coalesce("sk", F.lit(0.0))).alias("tau_skew"),
        F.when(flat, 0.0).otherwise(F.coalesce("ku", F.lit(0.0))).alias("tau_kurtosis"), F.col("q")[0].alias("tau_q10"), F.col("q")[1].alias("tau_q50"), F.col("q")[2].alias("tau_q90"),
        ((F.col("gs") - F.col("gm")) / (F.col("gs") + F.col("gm"))).alias("dispersion"),
    )


def correlation(x: str, y: str, least: int):
    """Pearson's correlation as an aggregate, clamped; 0 with fewer than `least` pairs or no spread (built-in corr fails there)."""
    n, cov = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)), F.covar_pop(x, y)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    sx, sy = F.stddev_pop(F.when(both, F.col(x))), F.stddev_pop(F.when(both, F.col(y)))
    value = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(cov, sx * sy)))
    return F.when((n >= least) & (sx >= _TINY) & (sy >= _TINY), value).otherwise(0.0)


def memory(inside: DataFrame) -> DataFrame:
    return inside.groupBy("account_id").agg(correlation("before", "gap", 3).alias("memory"))


def fano(e: DataFrame, widths=(60, 300, 900, 1800)) -> DataFrame:
    """log1p of the Fano factor of counts in windows from each session's first event, for each width."""
    w = Window.partitionBy("account_id", "session")
    rows = e.withColumn("first", F.min("t").over(w)).withColumn("last", F.max("t").over(w))
    sized = F.explode(F.array(*[F.lit(x) for x in widths])).alias("width")
    rows = rows.select("account_id", "session", "t", "first", "last", sized)
    total = F.greatest(F.lit(1), F.ceil((F.col("last") - F.col("first")) / F.col("width"))).cast("long")
    rows = rows.withColumn("windows", total).withColumn("at", F.least(F.col("windows") - 1, F.floor((F.col("t") - F.col("first")) / F.col("width"))))
    cells = rows.groupBy("account_id", "session", "width", "windows", "at").agg(F.count("*").alias("n"))
    each = cells.groupBy("account_id", "session", "width", "windows").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    all_ = each.groupBy("account_id", "width").agg(F.sum("windows").alias("w"), F.sum("n").alias("n"), F.sum("n2").alias("n2"))
    mean = F.col("n") / F.col("w")
    value = F.log1p(F.greatest(F.lit(0.0), F.col("n2") / F.col("w") - mean * mean) / F.greatest(F.lit(1e-9), mean))
    return all_.select("account_id", "width", value.alias("fano"))


def lengths_and_gaps(inside: DataFrame) -> DataFrame:
    """Typing speed after short gaps, and the correlation of lengths and gaps."""
    rows = inside.withColumn("v", F.when(F.col("gap") <= 120, F.col("len") / F.greatest(F.lit(1.0), F.col("gap")))).withColumn("ll", F.log1p("len")).withColumn("lg", F.log1p("gap"))
    q = F.percentile("v", F.array(F.lit(0.5), F.lit(0.9))).alias("q")
    g = rows.groupBy("account_id").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), q, correlation("ll", "lg", 2).alias("length_corr"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return g.select("account_id", zero(F.col("m")).alias("v_mean"), zero(F.col("s")).alias("v_std"), zero(F.get("q", F.lit(0))).alias("v_q50"), zero(F.get("q", F.lit(1))).alias("v_q90"), "length_corr")


def session_shape(e: DataFrame) -> DataFrame:
    """Sizes, durations and endpoints of sessions."""
    s = e.groupBy("account_id", "session").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).withColumn("d", F.col("b") - F.col("a"))
    ca, sa = wave(F.col("a"), 1, 86400.0)
    cb, sb = wave(F.col("b"), 1, 86400.0)
    g = s.groupBy("account_id").agg(
        F.log1p(F.avg("n")).alias("size"), (F.stddev_pop("n") / F.avg("n")).alias("size_cv"), F.log1p(F.avg("d")).alias("duration"), F.stddev_pop(F.log1p("d")).alias("duration_std"),
        F.avg((F.col("n") == 1).cast("double")).alias("singletons"), ca.alias("start_cos"), sa.alias("start_sin"), cb.alias("end_cos"), sb.alias("end_sin"),
    )
    return g


def features(e: DataFrame) -> DataFrame:
    """(account_id, idx, value) for idx 0 to 121."""
    parts, at = [], 0

    def add(wide: DataFrame, names=None):
        nonlocal at
        names = names or [c for c in wide.columns if c != "account_id"]
        parts.append(_long(wide, at, names))
        at += len(names)

    add(daily(e))
    add(weekly(e))
    smooth = smoothed(e)
    parts.append(smooth.select("account_id", F.posexplode("bins").alias("i", "value")).select("account_id", (F.col("i") + at).alias("idx"), "value"))
    at += 48
    add(rhythm(smooth))
    add(weekend(e))
    inside = gaps(e)
    add(burst(intervals(e, inside)))
    everyone = e.select("account_id").distinct()
    full = lambda d, names: everyone.join(d, "account_id", "left").fillna(0.0, names)
    add(full(memory(inside), ["memory"]))
    f = fano(e).withColumn("idx", F.lit(at) + F.when(F.col("width") == 60, 0).when(F.col("width") == 300, 1).when(F.col("width") == 900, 2).otherwise(3))
    parts.append(f.select("account_id", "idx", F.col("fano").alias("value")))
    at += 4
    names = ["v_mean", "v_std", "v_q50", "v_q90", "length_corr"]
    add(full(lengths_and_gaps(inside), names), names)
    add(session_shape(e))
    assert at == 122, at
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def fit(feature_rows: DataFrame) -> DataFrame:
    """(idx, mean, std) over accounts, population form."""
    return fitted(feature_rows)


def block_of(idx, blocks=BLOCKS):
    b = F.lit(len(blocks) - 1)
    for k in range(len(blocks) - 2, -1, -1):
        b = F.when(idx < blocks[k + 1][0], k).otherwise(b)
    return b


def vectors(feature_rows: DataFrame, stats: DataFrame, weights=(0.45, 0.30, 0.25)) -> DataFrame:
    """(account_id, idx, w): standardised, normalised by block, weighted, normalised as a whole."""
    return block_unit(feature_rows, stats, block_of(F.col("idx")), weights)
