"""Time-window resampling per identifier: tumbling, sliding and gapped."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from math import gcd

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.time import epoch_us, from_epoch, utc_session
from ..schema import has_point, require_aggregates, require_columns, require_positive, series_keys
from ..scratch import pin
from .resample_kernel import window_batches
from .rowindex import HOT_ROWS, with_row_index
from .selection_kernel import ENTRY, QUESTION, narrow_batches, select_batches

SECOND_US = 1_000_000

# Rows of one bin of a hot block, in which a task picks medians, and running counts one task holds to find the bin.
BIN_ROWS = 250_000
COUNTED_CELLS = 1 << 22


def floor_to(us, width_us: int) -> Column:
    """Largest multiple of ``width_us`` that is not after ``us`` (floors before 1970 too)."""
    return us - F.pmod(us, F.lit(width_us))


class _Windows:
    """The window layout: which starts a moment belongs to.

    Neighbouring starts are grouped into blocks four times as long as the
    starts of one moment reach, so a moment concerns one block or, one time in
    four, two. Shuffling by block moves 1.25 rows per row at most, however many
    windows it is in.
    """

    def __init__(self, every_s: int, period_s: int):
        self.every = every_s * SECOND_US
        self.period = period_s * SECOND_US
        self.count = -(-self.period // self.every)
        self.pane = gcd(self.every, self.period)
        self.block = 4 * self.count * self.every if self.count > 1 else self.every

    def blocks(self, points: DataFrame) -> DataFrame:
        """Each row once per block it concerns, as ``block``."""
        if self.count == 1:
            placed = points.withColumn("block", floor_to(F.col("us"), self.every))
            return placed.where(F.col("us") < F.col("block") + F.lit(self.period))
        last = floor_to(F.col("us"), self.every)
        newest = floor_to(last, self.block)
        oldest = floor_to(last - F.lit((self.count - 1) * self.every), self.block)
        concerned = F.when(oldest == newest, F.array(newest)).otherwise(F.array(oldest, newest))
        return points.withColumn("block", F.explode(concerned))


def _means(points: DataFrame, keys: list[str], windows: _Windows) -> DataFrame:
    """Means of windows that do not overlap, combined map-side."""
    assigned = windows.blocks(points).withColumnRenamed("block", "start")
    return assigned.groupBy(*keys, "start").agg(F.avg("v").alias("mean"))


def _panes(points: DataFrame, keys: list[str], windows: _Windows) -> DataFrame:
    """Sum ``v`` and count ``n`` of every pane, the stretches that window starts and ends cut time into; combined map-side."""
    pane = floor_to(F.col("us"), windows.pane).alias("us")
    return points.groupBy(*keys, pane).agg(F.sum("v").alias("v"), F.count("v").alias("n"))


def _opened(blocked: DataFrame, firsts: DataFrame | None, windows: _Windows) -> DataFrame:
    """Rows in blocks, and each series' first row once more as a mark in the blocks it concerns.

    ``firsts`` has the series' keys and ``us`` of their first rows; a mark has no value and says to the kernel that
    nothing comes before it. ``None`` keeps leading windows.
    """
    if firsts is None:
        return blocked
    absent = [F.lit(None).cast(blocked.schema[c].dataType).alias(c) for c in blocked.columns if c not in (*firsts.columns, "block", "n")]
    marks = windows.blocks(firsts).select("*", *absent, *([F.lit(0).cast("bigint").alias("n")] if "n" in blocked.columns else []))
    return blocked.withColumn("opens", F.lit(False)).unionByName(marks.withColumn("opens", F.lit(True)))


def _by_kernel(rows: DataFrame, keys: list[str], windows: _Windows, aggs: tuple[str, ...]) -> DataFrame:
    """``(keys, start, aggs)``: one shuffle by block, and one walk over the sorted rows of each."""
    every, period, block = windows.every, windows.period, windows.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return window_batches(batches, keys, every, period, block, aggs)

    home = [*keys, "block"]
    schema = T.StructType(
        [rows.schema[key] for key in keys]
        + [T.StructField("start", T.LongType())]
        + [T.StructField(agg, T.LongType() if agg == "n" else T.DoubleType()) for agg in aggs]
    )
    return rows.repartition(*home).sortWithinPartitions(*home, "us").mapInArrow(run, schema)


def _sliding_means(points: DataFrame, keys: list[str], windows: _Windows, leading: bool) -> DataFrame:
    """Means over panes, so that what is shuffled grows with panes, not with rows."""
    panes = _panes(points, keys, windows)
    firsts = None
    if not leading:
        # All columns are in the least struct, so both readers of the panes want the same columns and share one shuffle.
        firsts = panes.groupBy(*keys).agg(F.min(F.struct("us", "v", "n")).alias("p")).select(*keys, "p.us")
    return _by_kernel(_opened(windows.blocks(panes), firsts, windows), keys, windows, ("mean",))


def _of_hot(blocked: DataFrame, firsts: DataFrame | None, keys: list[str], windows: _Windows, aggs: tuple[str, ...], bin_rows: int) -> DataFrame:
    """Windows of blocks too large for one task; the same result.

    Means come from panes. For medians the rows of a block are numbered by value, over range partitions, and the middle
    numbers of each window are narrowed to ever smaller bins of numbers: per level, rows are counted map-side by (bin,
    pane, next smaller bin), and windows find their middle among the counts of their panes. In the last bins, of at most
    ``bin_rows`` rows, they are picked. Rows are never multiplied by their windows.
    """
    home = [*keys, "block"]
    panes = _opened(_panes(blocked, home, windows), firsts, windows)
    if firsts is not None:
        panes = panes.join(pin(blocked.select(*home).distinct(), "hot-blocks"), home, "left_semi")  # marks of these blocks only
    results = _by_kernel(panes, keys, windows, ("mean", "n"))
    results = pin(results.withColumn("block", floor_to(F.col("start"), windows.block)), "hot-windows")
    if "median" not in aggs:
        return results.select(*keys, "start", *aggs)

    known = blocked.where(F.col("v").isNotNull()).select(*home, "us", "v").withColumn("tie", F.monotonically_increasing_id())
    placed = with_row_index(known, *home, "v", "us", "tie", name="at").drop("tie")
    extent = pin(placed.groupBy(*home).agg(F.min("at").alias("from"), F.count("*").alias("size")), "hot-extents")
    largest = extent.agg(F.max("size")).first()[0] or 0
    ranked = placed.join(extent, home).select(*home, "us", "v", (F.col("at") - F.col("from")).alias("rank"))

    panes_of_block = -(-(windows.block + windows.period) // windows.pane)
    parts = int(min(256, max(2, COUNTED_CELLS // panes_of_block)))
    width = bin_rows
    while width < largest:
        width *= parts
    n = F.col("n")
    middle = F.array_distinct(F.array(F.call_function("div", n - 1, F.lit(2)), F.call_function("div", n, F.lit(2))))
    questions = results.where(n > 0).select(*home, F.lit(0).cast("bigint").alias("bin"), "start", F.explode(middle).alias("k"))

    def ask(entries: DataFrame, kind: Callable, schema: str) -> DataFrame:
        """Entries and questions, sorted together, through a kernel."""
        last = entries.schema.fields[-1]
        asked = questions.select(*home, "bin", F.col("start").alias("at"), F.col("k").alias("x"), F.lit(0).cast(last.dataType).alias(last.name))
        mixed = entries.withColumn("kind", F.lit(ENTRY)).unionByName(asked.withColumn("kind", F.lit(QUESTION)))
        mixed = mixed.repartition(*home, "bin").sortWithinPartitions(*home, "bin", "kind", "at")
        fields = ", ".join(f"{key} {blocked.schema[key].dataType.simpleString()}" for key in home)
        return mixed.mapInArrow(kind, f"{fields}, {schema}")

    def live(rows: DataFrame, bin_width: int) -> DataFrame:
        """Rows, with ``bin``, that some question can still mean."""
        binned = rows.withColumn("bin", F.call_function("div", "rank", F.lit(bin_width)))
        return binned if bin_width >= largest else binned.join(questions.select(*home, "bin").distinct(), [*home, "bin"], "left_semi")

    period = windows.period
    while width > bin_rows:
        finer = F.call_function("div", "rank", F.lit(width // parts))
        counted = live(ranked, width).groupBy(*home, "bin", floor_to(F.col("us"), windows.pane).alias("at"), finer.alias("x")).agg(F.count("*").alias("n"))
        questions = pin(ask(counted, lambda batches: narrow_batches(batches, home, parts, period), "bin bigint, start bigint, k bigint"), "questions")
        width //= parts
    entries = live(ranked, bin_rows).select(*home, "bin", F.col("us").alias("at"), F.col("rank").alias("x"), "v")
    picked = ask(entries, lambda batches: select_batches(batches, home, period), "start bigint, v double")
    medians = picked.groupBy(*home, "start").agg(F.avg("v").alias("median"))
    return results.join(medians, [*home, "start"], "left").select(*keys, "start", *aggs)


def _over_blocks(
    points: DataFrame, keys: list[str], windows: _Windows, aggs: tuple[str, ...], leading: bool, hot_rows: int, bin_rows: int
) -> DataFrame:
    # One row per series, combined map-side: its first row, and whether any of its blocks can be too large for a task.
    series = pin(points.groupBy(*keys).agg(F.min("us").alias("us"), F.count(F.lit(1)).alias("rows")), "series")
    firsts = None if leading or windows.count == 1 else series.select(*keys, "us")
    blocked = windows.blocks(points)
    large = series.where(F.col("rows") > hot_rows).select(*keys)
    if large.isEmpty():
        return _by_kernel(_opened(blocked, firsts, windows), keys, windows, aggs)
    home = [*keys, "block"]
    sizes = blocked.join(large, keys, "left_semi").groupBy(*home).agg(F.count(F.lit(1)).alias("size"))
    hot = pin(sizes.where(F.col("size") > hot_rows).select(*home), "hot-blocks")
    # No hint: the written table's size decides between a broadcast and a shuffle.
    cold = _by_kernel(_opened(blocked, firsts, windows).join(hot, home, "left_anti"), keys, windows, aggs)
    if hot.isEmpty():
        return cold
    return cold.unionByName(_of_hot(blocked.join(hot, home, "left_semi"), firsts, keys, windows, aggs, bin_rows))


def resample(
    df: DataFrame,
    every_s: int = 60,
    period_s: int = 120,
    aggs=("mean",),
    leading: str = "drop",
    *,
    id_col: str | Sequence[str] | None = None,
    ts_col: str = "ts",
    value_col: str = "value",
    hot_rows: int = HOT_ROWS,
    bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """Mean and/or median of ``value_col`` per series and time window.

    A series is told apart by ``id_col``, one column or several; by default ``metric``, where there is one, and
    ``identifier``, so that readings of different metrics are never averaged together.

    A window starts every ``every_s`` seconds (multiples since 1970) and covers
    ``[start, start + period_s)``: tumbling when the two are equal, sliding when
    the period is longer, gapped when it is shorter. Windows without rows are
    not emitted; null values are ignored; rows without identifier or time are
    left out. Means are not rounded.

    ``leading="drop"`` leaves out windows that start before the pane of the
    identifier's first row; ``"keep"`` emits them.

    Returns ``(metric?, identifier, ts, mean?, median?)`` with ``ts`` the window start.
    """
    aggs = require_aggregates(aggs)
    require_positive(every_s=every_s, period_s=period_s, hot_rows=hot_rows, bin_rows=bin_rows)
    ids = series_keys(df, id_col)
    require_columns(df, ts_col, value_col)
    if leading not in ("drop", "keep"):
        raise ValueError(f"leading must be 'drop' or 'keep', got {leading!r}")
    windows = _Windows(every_s, period_s)
    if windows.count > 1000:
        warnings.warn(f"each row falls into {windows.count} windows", stacklevel=2)

    utc = utc_session(df.sparkSession)
    keys = [f"key{i}" for i in range(len(ids))]  # other names could clash with the working columns
    points = df.where(has_point(ids, ts_col)).select(
        *[F.col(name).alias(key) for name, key in zip(ids, keys)], epoch_us(ts_col, utc).alias("us"), F.col(value_col).cast("double").alias("v")
    )
    if "median" in aggs:
        results = _over_blocks(points, keys, windows, aggs, leading == "keep", hot_rows, bin_rows)
    elif windows.count > 1:
        results = _sliding_means(points, keys, windows, leading == "keep")
    else:
        results = _means(points, keys, windows)
    return results.select(*[F.col(key).alias(name) for key, name in zip(keys, ids)], from_epoch("start", utc=utc).alias(ts_col), *aggs)
