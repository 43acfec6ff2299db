"""Series of one value per identifier and time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.time import epoch_ms, utc_session
from ..schema import has_point, require_columns, require_positive, series_keys
from ..scratch import pin
from .rowindex import with_row_index

MAX_POINTS = 100_000


def source_series(
    df: DataFrame,
    *,
    id_col: str | Sequence[str] | None = None,
    ts_col: str = "ts",
    value_col: str = "value",
    seq_col: str | None = "seq",
) -> DataFrame:
    """The raw series ``(metric?, identifier, ts, seq?, x, y)``: ``x`` in epoch milliseconds, ``y`` a double.

    Order is left to whoever writes or shows the rows.
    """
    ids = series_keys(df, id_col)
    require_columns(df, ts_col, value_col)
    return df.where(has_point(ids, ts_col)).select(
        *ids,
        ts_col,
        *([seq_col] if seq_col else []),
        epoch_ms(ts_col, utc_session(df.sparkSession)).alias("x"),
        F.col(value_col).cast("double").alias("y"),
    )


def to_points(
    series: DataFrame,
    max_points: int = MAX_POINTS,
    *,
    id_col: str | Sequence[str] | None = None,
    seq_col: str | None = "seq",
) -> DataFrame:
    """Gather a series into arrays: ``(metric?, identifier, chunk, points)``, points = ``[{x, y}]`` by time.

    No array is longer than ``max_points``; a longer series continues in the
    next chunk, so nothing is cut off and no task gathers a whole identifier.
    """
    require_positive(max_points=max_points)
    order = ["x"] + ([seq_col] if seq_col else [])
    ids = series_keys(series, id_col)
    require_columns(series, "y", *order)
    sizes = series.groupBy(*ids).agg(F.count(F.lit(1)).alias("__sf_n"))
    hot = sizes.where(F.col("__sf_n") > max_points).select(*ids)
    # Only identifiers with more points than an array holds are numbered; the others are gathered as they are.
    parts = [series.withColumn("chunk", F.lit(0).cast("bigint"))]
    if not hot.isEmpty():
        hot = pin(hot, "long-series")
        parts = [parts[0].join(hot, ids, "left_anti")]
        placed = with_row_index(series.join(hot, ids, "left_semi"), *ids, *order, name="__sf_at")
        first = placed.groupBy(*ids).agg(F.min("__sf_at").alias("__sf_first"))
        position = F.col("__sf_at") - F.col("__sf_first")
        placed = placed.join(first, ids).withColumn("chunk", F.floor(position / F.lit(max_points)))
        parts.append(placed.select(*parts[0].columns))
    placed, keys, sort_key = reduce(DataFrame.unionByName, parts), [*ids, "chunk"], order
    entry = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(sort_key)], F.col("x"), F.col("y"))
    gathered = placed.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("points"))
    return gathered.withColumn(
        "points", F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    )
