"""Running sums in the order of a value, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values that are summed apart.
CELLS = 256


def running(rows: DataFrame, key: str, sums: dict[str, str], descending: bool = False, cells: int = CELLS) -> DataFrame:
    """rows with a column for each name in sums: the sum of its column over all rows up to and with this one, in the order of key.

    Values are dealt into ranges by quantiles, so that ranges have about as many rows each; the sums of the
    few ranges are added to the sums within them. Rows with equal keys get equal sums.
    """
    bounds = sorted(set(rows.approxQuantile(key, [i / cells for i in range(1, cells)], 1 / (4 * cells))))
    cell = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(key))) if bounds else F.lit(0)
    rows = rows.withColumn("_cell", cell)
    order = lambda c: F.desc(c) if descending else F.asc(c)
    few = rows.groupBy("_cell").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(F.lit(0)).orderBy(order("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    few = few.select("_cell", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    within = Window.partitionBy("_cell").orderBy(order(key))
    joined = rows.join(F.broadcast(few), "_cell")  # a row for each range
    return joined.select(*[c for c in rows.columns if c != "_cell"], *[(F.col(f"_{n}") + F.sum(c).over(within)).alias(n) for n, c in sums.items()])
