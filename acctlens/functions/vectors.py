"""Long vectors (account_id, idx, w): standardising, block norms, cosines."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fitted(rows: DataFrame) -> DataFrame:
    """(idx, mean, std) over accounts, population form. The std of equal values is 0 as it is by its definition: merging
    partial moments can leave a rounding error instead, which would then be divided by."""
    std = F.when(F.min("value") == F.max("value"), 0.0).otherwise(F.stddev_pop("value"))
    return rows.groupBy("idx").agg(F.avg("value").alias("mean"), std.alias("std"))


def standardize(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """value as (value - mean) / std; 0 where std is 0. stats has a row for each idx, so it is broadcast."""
    z = F.when(F.col("std") == 0, 0.0).otherwise(F.try_divide(F.col("value") - F.col("mean"), F.col("std")))
    return rows.join(F.broadcast(stats), "idx").select("account_id", "idx", F.coalesce(z, F.lit(0.0)).alias("z"))


def block_unit(rows: DataFrame, stats: DataFrame, block, weights) -> DataFrame:
    z = standardize(rows, stats).withColumn("block", block)
    per_block = Window.partitionBy("account_id", "block")
    norm = F.sqrt(F.sum(F.col("z") * F.col("z")).over(per_block))
    weight = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("block"))
    u = z.withColumn("u", F.when(norm > 0, F.col("z") / norm).otherwise(0.0) * weight)
    return unit(u.select("account_id", "idx", F.col("u").alias("w")))


def unit(rows: DataFrame) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("account_id")))
    return rows.select("account_id", "idx", F.when(norm > 0, F.col("w") / norm).otherwise(0.0).alias("w"))


def packed(rows: DataFrame) -> DataFrame:
    """(account_id, idx, w) with a row for each account: its dimensions that aren't 0, in rising order, as arrays."""
    idx = F.col("idx") if dict(rows.dtypes)["idx"] == "string" else F.col("idx").cast("long")
    rows = rows.filter("w <> 0").select("account_id", F.struct(idx.alias("i"), "w").alias("d"))
    g = rows.groupBy("account_id").agg(F.array_sort(F.collect_list("d")).alias("d"))
    return g.select("account_id", F.col("d.i").alias("idx"), F.col("d.w").alias("w"))


def pair_cosine(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, cosine) of unit vectors for the given pairs; dimensions that either lacks count as 0.

    Vectors are joined to pairs, not to each other, so the work follows the pairs and never all accounts squared. A
    vector is shuffled as one row, and a pair's product is one sum over both rows.
    """
    own = packed(rows)
    side = lambda s: own.select(F.col("account_id").alias(s), F.col("idx").alias(f"i{s}"), F.col("w").alias(f"w{s}"))
    both = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "ia", "wa", "ib", "wb")
    schema = pairs.select("a", "b", F.lit(0.0).alias("cosine")).schema

    def run(batches):
        for x in batches:
            for part in parts(x, 2):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.clip(dots(part), -1.0, 1.0))], names=["a", "b", "cosine"])

    return both.mapInArrow(run, schema)


def parts(batch: pa.RecordBatch, column: int, most: int = 1 << 19):
    """Slices of the batch whose lists come to about `most` values each; a longer list is a slice by itself."""
    end = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(end, (end[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def dots(batch: pa.RecordBatch) -> np.ndarray:
    """Products of two sparse vectors in each row (columns 2 to 5: dimensions in rising order and values, twice)."""

    def flat(i):
        sizes = pc.fill_null(pc.list_value_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
        idx, w = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (i, i + 1))
        return np.repeat(np.arange(batch.num_rows, dtype=np.int64), sizes), idx, w

    (row, ia, wa), (other, ib, wb) = flat(2), flat(4)
    if not len(ia) or not len(ib):
        return np.zeros(batch.num_rows)
    if ia.dtype == object:  # dimensions that are texts are numbered, and the first side put in that order
        both = pd.factorize(np.concatenate((ia, ib)))[0]
        ia, ib = both[: len(ia)], both[len(ia) :]
        order = np.lexsort((ia, row))
        row, ia, wa = row[order], ia[order], wa[order]
    # A row and a dimension in one number; the first side is in its order.
    span = max(ia.max(), ib.max()) + 1
    left, right = row * span + ia, other * span + ib
    at = np.minimum(np.searchsorted(left, right), len(left) - 1)
    hit = np.flatnonzero(left[at] == right)
    return np.bincount(other[hit], wa[at[hit]] * wb[hit], batch.num_rows)


def dense_cosine(a, b):
    """Cosine of two array columns, clamped; 0 where either is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / norm))).otherwise(0.0)
