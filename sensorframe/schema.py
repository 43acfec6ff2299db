"""Names and types of the canonical readings table, and argument checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

READINGS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("identifier", T.LongType()),  # DECIMAL(20,0) for unsigned 64-bit logs
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("seq", T.LongType()),  # tie-breaker among equal timestamps
        T.StructField("width", T.IntegerType()),  # columns of the original log
    ]
)

AGGREGATES = ("mean", "median")

ROUND_DECIMALS = 6


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")


def require_aggregates(aggs) -> tuple[str, ...]:
    chosen = (aggs,) if isinstance(aggs, str) else tuple(aggs)
    unknown = [agg for agg in chosen if agg not in AGGREGATES]
    if unknown or not chosen:
        raise ValueError(f"aggs must be drawn from {AGGREGATES}, got {aggs!r}")
    return chosen


def require_positive(**values: int) -> None:
    for name, value in values.items():
        if not isinstance(value, int) or isinstance(value, bool) or value < 1:
            raise ValueError(f"{name} must be a whole number >= 1, got {value!r}")


def series_keys(df: DataFrame, id_col: str | Sequence[str] | None) -> list[str]:
    """Columns that tell series apart: those given, or ``metric`` (where there is one) and ``identifier``.

    Readings of several metrics never share a series unless that is asked for with ``id_col="identifier"``.
    """
    if id_col is None:
        keys = [name for name in ("metric", "identifier") if name in df.columns]
        id_col = keys if "identifier" in keys else ["identifier"]
    keys = [id_col] if isinstance(id_col, str) else list(id_col)
    if not keys:
        raise ValueError("a series needs at least one key column")
    require_columns(df, *keys)
    return keys


def has_point(keys: Sequence[str], ts_col: str) -> Column:
    """Rows that can stand on a series: the identifier (the last key) and the time are known."""
    return F.col(keys[-1]).isNotNull() & F.col(ts_col).isNotNull()
