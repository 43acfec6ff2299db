"""Tables kept sorted on disk, so that any page of them is read without sorting again."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import require_columns
from ..scratch import scratch_path
from .table import sort_order

_AT, _PART = "__sf_at", "__sf_part"


@dataclass(frozen=True)
class KeptOrder:
    """A table in one order below ``path``: its rows by range of the order, and where each range begins."""

    spark: SparkSession
    path: str

    @cached_property
    def ranges(self) -> DataFrame:
        """``part, first, rows``: one row per file of the table, in order."""
        return self.spark.read.schema("part bigint, first bigint, rows bigint").parquet(f"{self.path}/ranges")

    @cached_property
    def empty(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/schema")

    def count(self) -> int:
        return self.ranges.agg(F.sum("rows")).first()[0] or 0

    def page(self, offset: int, limit: int, *, name: str | None = None) -> DataFrame:
        """``limit`` rows from position ``offset``, in order, out of the files that hold them; ``name`` adds the position."""
        if offset < 0 or limit < 0:
            raise ValueError("offset and limit must not be negative")
        held = self.ranges.where((F.col("first") < offset + limit) & (F.col("first") + F.col("rows") > offset)).collect()
        rows = f"{self.path}/rows"
        own, position = self.empty.columns, name or "__sf_place"
        if not held:
            table = self.empty.withColumn(position, F.lit(0).cast("bigint"))
        else:
            held.sort(key=lambda r: r["first"])
            schema = T.StructType([*self.empty.schema.fields, T.StructField(_AT, T.LongType()), T.StructField(_PART, T.LongType())])
            table = self.spark.read.schema(schema).option("basePath", rows).parquet(*[f"{rows}/{_PART}={r['part']}" for r in held])
            firsts = F.create_map(*[F.lit(x) for r in held for x in (r["part"], r["first"])])
            # of the first and last file only the rows of the page; the numbers rise along a file
            low, high = max(0, offset - held[0]["first"]), offset + limit - held[-1]["first"]
            part, at = F.col(_PART), F.col(_AT)
            table = table.where(((part != held[0]["part"]) | (at >= low)) & ((part != held[-1]["part"]) | (at < high)))
            table = table.withColumn(position, firsts[part] + at)
        return table.orderBy(position).select(*own, *([name] if name else []))


def keep_order(df: DataFrame, by: str = "ts", order: str = "asc", *, seq_col: str | None = "seq", path: str | None = None) -> KeptOrder:
    """Sort ``df`` once and keep it below ``path``, a new folder (by default one in the scratch folder).

    Eager. The rows are partitioned by range of the whole order and written sorted; the number of rows of each range,
    one short row, tells where it begins. ``open_order`` takes a kept table up again.
    """
    require_columns(df, by)
    spark, keys = df.sparkSession, sort_order(by, order, seq_col)
    path = path or scratch_path(spark, "kept-order")
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_AT, F.monotonically_increasing_id())
    laid = laid.withColumns({_PART: F.shiftright(_AT, 33), _AT: F.col(_AT).bitwiseAND(F.lit((1 << 33) - 1))})
    laid.write.partitionBy(_PART).parquet(f"{path}/rows")
    spark.createDataFrame([], df.schema).write.parquet(f"{path}/schema")
    written = spark.read.schema(f"{_PART} bigint").parquet(f"{path}/rows").groupBy(F.col(_PART).alias("part")).agg(F.count("*").alias("rows"))
    first, ranges = 0, []
    for part, rows in sorted(map(tuple, written.collect())):  # one short row per file
        ranges.append((part, first, rows))
        first += rows
    spark.createDataFrame(ranges, "part bigint, first bigint, rows bigint").coalesce(1).write.parquet(f"{path}/ranges")
    return KeptOrder(spark, path)


def open_order(spark: SparkSession, path: str) -> KeptOrder:
    """The table that ``keep_order`` keeps below ``path``."""
    return KeptOrder(spark, path)
