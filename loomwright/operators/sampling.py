"""Places in a global order without sorting in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def global_positions(df: DataFrame, order: list[Column], partitions: int = 32) -> DataFrame:
    """Add ``position`` (from 0): rows are range-partitioned and sorted, and each partition is shifted by the sizes of those before."""
    rows = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    rows = rows.select("*", F.monotonically_increasing_id().alias("__m")).withColumn("__p", F.shiftright("__m", 33)).withColumn("__i", F.expr("__m & ((1L << 33) - 1)"))
    rows = rows.persist()
    sizes = {r["__p"]: r["count"] for r in rows.groupBy("__p").count().collect()}  # a row per partition
    shift, before = [], 0
    for p in range(max(sizes, default=-1) + 1):
        shift.append(before)
        before += sizes.get(p, 0)
    starts = F.array(*[F.lit(x).cast("long") for x in shift]) if shift else F.array(F.lit(0).cast("long"))
    return rows.withColumn("position", F.element_at(starts, (F.col("__p") + 1).cast("int")) + F.col("__i")).withColumn("__n", F.lit(before)).drop("__m", "__p", "__i")


def evenly_spaced(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The rows at the rounded positions k(size-1)/(n-1)."""
    placed = global_positions(df, order)
    k = F.round(F.col("position") * (n - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    near = lambda j: F.round(j * (F.col("__n") - 1) / float(n - 1)) == F.col("position")
    return placed.where(near(k) | near(k - 1) | near(k + 1)).drop("__n")
