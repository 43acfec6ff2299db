"""Export of a table view with its cells formatted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.identifiers import hex_id
from ..functions.time import format_ts, instant_to_ntz

_PLAIN = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.StringType,
    T.BooleanType,
)
_FLOATS = (T.FloatType, T.DoubleType)
_UNSIGNED_64 = T.DecimalType(20, 0)


def _cell(field: T.StructField, precision: int | None, tz: str | None) -> Column:
    column, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.LongType) or kind == _UNSIGNED_64:
        cell = hex_id(column, kind)
    elif isinstance(kind, T.TimestampNTZType):
        cell = format_ts(column, tz)
    elif isinstance(kind, T.TimestampType):
        cell = format_ts(instant_to_ntz(column), tz)
    elif isinstance(kind, _FLOATS):
        cell = column if precision is None else F.round(column, precision)
    elif isinstance(kind, _PLAIN):
        cell = column
    elif isinstance(kind, T.NullType):
        cell = column.cast("string")  # a column without a type is a column of blanks
    else:
        raise TypeError(f"column {field.name!r} of type {kind.simpleString()} cannot be exported")
    return cell.alias(field.name)


def export_view(df: DataFrame, precision: int | None = None, tz: str | None = None) -> DataFrame:
    """All columns as export cells: 64-bit integers in hex, times as text, the rest unchanged."""
    return df.select(*[_cell(field, precision, tz) for field in df.schema.fields])


def write_export(df: DataFrame, path: str, fmt: str = "csv", **view) -> None:
    """Write the export view as CSV with a header row or as Parquet.

    CSV cells are quoted by doubling quotes (RFC 4180); a null is blank, an empty text is ``""``. Sorted input stays
    sorted: each file holds one range, files follow in order.
    """
    cells = export_view(df, **view)
    if fmt == "csv":
        cells.write.options(header=True, nullValue="", emptyValue='""', quote='"', escape='"').csv(path)
    elif fmt == "parquet":
        cells.write.parquet(path)
    else:
        raise ValueError(f"fmt must be csv or parquet, got {fmt!r}")
