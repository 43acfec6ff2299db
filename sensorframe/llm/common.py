"""What several operators share: rows as (id, bytes), ranks inside groups, links to components."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import pin

#: Exactly the characters \x20 and \x09-\x0D, on which ``bytes.split()`` splits.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def body(text_col: str = "text") -> Column:
    """The text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def id_and_body(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under its own names, so that other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col).alias("body"))


def batch_of(schema: pa.Schema, columns: Iterable[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(columns, schema.types, strict=True)], schema=schema
    )


def rank_in_groups(df: DataFrame, group: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Add ``rank`` (long, gapless from 0 in each group of ``group`` along ``order``) to ``df``.

    The rows are range-partitioned on group and order and written once, so a group of any size spreads over many tasks.
    Rows number themselves inside their file, and the few (partition, group) pairs, at most partitions plus groups, are
    summed up to where each begins. Rows alike in all of ``order`` get different ranks, in any order; a number of their
    own keeps even very many of them from meeting in one partition. ``df`` is read twice, as Spark samples it for the
    ranges, so it should be cheap or written.
    """
    keys = [*group, *order, "_tie"]
    laid = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = pin(laid.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), label)
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    runs = laid.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # A group has one short row for each partition it reaches.
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = pin(runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"), f"{label}-runs")
    names = ["_part", *group, "_first", "_before"]
    runs = runs.select(*[F.col(n).alias(f"r{n}") for n in names])
    on = [F.col("_part") == F.col("r_part"), *[F.col(k).eqNullSafe(F.col(f"r{k}")) for k in group]]
    out = laid.join(runs, on).withColumn("rank", F.col("_at") - F.col("r_first") + F.col("r_before"))
    return out.select(*df.columns, "rank")


def components(links: DataFrame, label: str) -> DataFrame:
    """Connected components of undirected ``links(a, b)``: ``node, component`` (smallest node) for every node.

    Large-star and small-star rounds (Kiveris et al., 2014): in each, every node hands its neighbours the smallest node
    around it, so the number of rounds is logarithmic in practice and no group is ever gathered. Each round is written
    and read again, and rounds go on until an edge set maps to itself, however long its chains are.
    """
    edges = pin(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b").distinct(), label)
    stamp = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    before = edges.agg(F.count("*").alias("n"), stamp).first()
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # smaller neighbours only: (u, smaller v) -> (v, m) and (u, m), with m the smallest
        down = large.where("a > b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = pin(small.where("a != b").distinct(), label)
        now = edges.agg(F.count("*").alias("n"), stamp).first()
        if now == before:
            break
        before = now
    star = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    centres = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return star.union(centres.join(star.select("node"), "node", "left_anti"))
