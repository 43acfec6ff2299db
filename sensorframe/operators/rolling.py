"""Rolling mean and median over the last N rows of each identifier."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..schema import AGGREGATES, ROUND_DECIMALS, has_point, require_aggregates, require_columns, require_positive, series_keys
from .rowindex import HOT_ROWS
from .chunks import CHUNK, CHUNK_ROWS, OWN, cut_identifiers
from .rolling_kernel import rolling_batches

def _by_kernel(
    df: DataFrame, keys: list[str], order: list[str], window_size: int, value_col: str, min_periods: int, aggs
) -> DataFrame:
    """The incremental kernel over each task's rows in sorted order: a row costs the same for any window length."""
    results = [f"rolling_{agg}" for agg in AGGREGATES if agg in aggs]
    schema = T.StructType(df.schema.fields + [T.StructField(name, T.DoubleType()) for name in results])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rolling_batches(batches, keys, value_col, window_size, min_periods, aggs)

    done = df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
    return done.withColumns({name: F.round(name, ROUND_DECIMALS) for name in results})


def rolling(
    df: DataFrame,
    window_size: int = 30,
    min_periods: int = 1,
    aggs=("mean",),
    *,
    id_col: str | Sequence[str] | None = None,
    ts_col: str = "ts",
    value_col: str = "value",
    seq_col: str | None = "seq",
    hot_rows: int = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Mean and/or median over the trailing ``window_size`` rows of each identifier.

    A series is told apart by ``id_col``, one column or several; by default ``metric``, where there is one, and
    ``identifier``. Rows are ordered by time, ties by ``seq_col``. One output row per input row
    that has an identifier and a time; a result is null while the frame holds
    fewer than ``min_periods`` non-null values, and is rounded to 6 decimals.

    One shuffle, by identifier. An identifier with more than ``hot_rows`` rows is
    cut into chunks of about ``chunk_rows`` that overlap by one window, and the
    shuffle is by chunk; finding out takes one eager count per identifier.

    Returns ``(metric?, identifier, ts, seq?, value, rolling_mean?, rolling_median?)``.
    """
    aggs = require_aggregates(aggs)
    require_positive(
        window_size=window_size, min_periods=min_periods, hot_rows=hot_rows, chunk_rows=chunk_rows
    )
    if min_periods > window_size:
        raise ValueError(f"min_periods {min_periods} exceeds window_size {window_size}")
    order = [ts_col] + ([seq_col] if seq_col else [])
    ids = series_keys(df, id_col)
    require_columns(df, value_col, *order)
    points = df.where(has_point(ids, ts_col)).select(
        *ids, *order, F.col(value_col).cast("double").alias(value_col)
    )
    chunks = cut_identifiers(points, ids, order, window_size - 1, hot_rows, chunk_rows)
    rows, keys = (points, ids) if chunks is None else (chunks, [*ids, CHUNK])
    done = _by_kernel(rows, keys, order, window_size, value_col, min_periods, aggs)
    return done if chunks is None else done.where(OWN).drop(CHUNK, OWN)
