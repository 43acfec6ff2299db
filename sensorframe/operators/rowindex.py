"""Sorted row numbers without a single-partition window."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import pin

# One task sorts this many rows (a few hundred MB, spillable) without trouble;
# a key with more rows is split.
HOT_ROWS = 5_000_000

_AT = "__sf_at"
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def with_row_index(df: DataFrame, *order: Column | str, name: str = "row_index") -> DataFrame:
    """Add the 0-based position of each row in the total order ``order``.

    Range partitioning on the whole order spreads even one dominant value, as
    long as the order ends in a tie-breaker. The sorted layout is written once;
    the number of rows per partition (one short row each) gives the offset at
    which each partition starts. Eager: it runs the sort.
    """
    spark = df.sparkSession
    placed = pin(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(_AT, F.monotonically_increasing_id()),
        "row-index",
    )
    part = F.shiftright(_AT, _LOCAL_BITS)
    counts = sorted(
        placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    )
    starts = accumulate((row["n"] for row in counts), initial=0)
    offsets = spark.createDataFrame(
        [(row["part"], start) for row, start in zip(counts, starts)] or [(0, 0)],
        "__sf_part bigint, __sf_start bigint",
    )
    local = F.col(_AT).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    # one row per sorted partition, counted above
    return (
        placed.withColumn("__sf_part", part)
        .join(F.broadcast(offsets), "__sf_part")
        .select(*df.columns, (F.col("__sf_start") + local).alias(name))
    )
