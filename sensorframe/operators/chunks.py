"""Cut identifiers with very many rows into chunks that overlap by one window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.time import epoch_us, utc_session
from ..scratch import pin
from .rowindex import with_row_index

CHUNK = "__sf_chunk"
OWN = "__sf_own"

# Rows of one chunk, the work of one task.
CHUNK_ROWS = 2_000_000

CELLS_PER_CHUNK = 16

# The grid of cells spans all but this share of an identifier's rows on either side; rows outside, such as one with a
# date in 1970, fall into its first or last cell.
STRAY = 0.001


def _homes(df: DataFrame, chunk: Column, in_next: Column) -> DataFrame:
    """Each row in its own chunk and, where ``in_next``, once more in the next one."""
    home = F.struct(chunk.alias("chunk"), F.lit(True).alias("own"))
    copy = F.struct((chunk + 1).alias("chunk"), F.lit(False).alias("own"))
    placed = df.withColumn("__sf_home", F.explode(F.when(in_next, F.array(home, copy)).otherwise(F.array(home))))
    return placed.withColumns({CHUNK: F.col("__sf_home.chunk"), OWN: F.col("__sf_home.own")}).drop("__sf_home")


def _cell(us: Column) -> Column:
    """Cell of a time: its place in the identifier's grid, the ends open."""
    inside = F.least(F.greatest(us, F.col("__sf_first")), F.col("__sf_last"))
    return F.call_function("div", inside - F.col("__sf_first"), F.col("__sf_width"))


def _by_time(
    points: DataFrame, grid: DataFrame, counts: DataFrame, us: Column, keys: list[str], overlap: int, chunk_rows: int
) -> DataFrame:
    """Chunks as runs of time cells.

    Running totals over the cells of an identifier, a small table, give the
    chunk of each cell; the rows themselves are shuffled once, later, by chunk.
    Cells hold at most half a chunk, so chunks are numbered without a gap and
    hold at least another half: a frame reaches back into one chunk at most.
    """
    along = Window.partitionBy(*keys).orderBy("__sf_cell")
    of_chunk = Window.partitionBy(*keys, "__sf_at")
    still_to_come = F.max("__sf_until").over(of_chunk) - F.col("__sf_until")
    time_map = (
        counts.withColumn("__sf_until", F.sum("__sf_rows").over(along))
        .withColumn("__sf_at", F.floor((F.col("__sf_until") - F.col("__sf_rows")) / F.lit(chunk_rows)))
        .withColumn("__sf_tail", still_to_come < overlap)
        .select(*keys, "__sf_cell", "__sf_at", "__sf_tail")
    )
    # No hints: the sizes of the written tables decide, and AQE splits what is skewed.
    placed = (
        points.join(grid, keys, "left")
        .withColumn("__sf_cell", _cell(us))
        .join(pin(time_map, "time-map"), [*keys, "__sf_cell"], "left")
        .select(*points.columns, F.coalesce("__sf_at", F.lit(0)).alias("__sf_at"), "__sf_tail")
    )
    homes = _homes(placed, F.col("__sf_at"), F.coalesce("__sf_tail", F.lit(False)))
    return homes.drop("__sf_at", "__sf_tail")


def _by_position(
    points: DataFrame, keys: list[str], order: list[str], overlap: int, chunk_rows: int
) -> DataFrame:
    """Chunks as runs of sorted rows: two shuffles, but whatever the times."""
    placed = with_row_index(points, *keys, *order, name="__sf_at")
    at = F.col("__sf_at")
    in_next = at % chunk_rows >= chunk_rows - overlap
    return _homes(placed, F.floor(at / F.lit(chunk_rows)), in_next).drop("__sf_at")


def cut_identifiers(
    points: DataFrame, keys: list[str], order: list[str], overlap: int, hot_rows: int, chunk_rows: int
) -> DataFrame | None:
    """Add chunk number ``CHUNK`` and ``OWN`` to the rows, or ``None`` if no identifier has more
    than ``hot_rows`` rows.

    Inside ``(identifier, chunk)`` every own row is preceded by at least
    ``overlap`` of its predecessors, as far as they exist; the copies that
    provide them have ``OWN = false``. Eager: rows are counted per identifier,
    combined map-side; the rest runs only if some identifier is hot.
    """
    us = epoch_us(order[0], utc_session(points.sparkSession))
    ends = F.percentile_approx(us, F.array(F.lit(STRAY), F.lit(1 - STRAY)), 10_000)
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("__sf_n")).where(F.col("__sf_n") > hot_rows)
    if sizes.isEmpty():
        return None
    grouped = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("__sf_n"), ends.alias("__sf_ends"))
    hot = pin(grouped.where(F.col("__sf_n") > hot_rows), "hot-identifiers")
    chunk_rows = max(chunk_rows, 2 * overlap + 2)
    first, last = F.col("__sf_ends")[0], F.col("__sf_ends")[1]
    cells = F.ceil(F.col("__sf_n") * CELLS_PER_CHUNK / F.lit(chunk_rows))
    width = F.greatest(F.ceil((last - first + 1) / cells), F.lit(1))
    grid = hot.select(*keys, first.alias("__sf_first"), last.alias("__sf_last"), width.alias("__sf_width"))
    counts = pin(
        points.join(grid, keys).groupBy(*keys, _cell(us).alias("__sf_cell")).agg(F.count(F.lit(1)).alias("__sf_rows")),
        "cells",
    )
    crowded = counts.where(F.col("__sf_rows") > chunk_rows // 2).select(*keys).distinct()
    if crowded.isEmpty():
        return _by_time(points, grid, counts, us, keys, overlap, chunk_rows)
    # Rows that crowd at single moments cannot be cut by time.
    crowded = pin(crowded, "crowded-identifiers")
    spread = points.join(crowded, keys, "left_anti")
    counts = counts.join(crowded, keys, "left_anti")
    return _by_time(spread, grid, counts, us, keys, overlap, chunk_rows).unionByName(
        _by_position(points.join(crowded, keys, "left_semi"), keys, order, overlap, chunk_rows)
    )
