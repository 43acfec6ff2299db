"""Identifier display: unsigned 64-bit numbers as lower-case hex."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def hex_id(column, data_type: T.DataType | None = None) -> Column:
    """Lower hex without prefix, of any whole number up to 64 bits; negative ones as two's complement.

    Unsigned 64-bit columns are DECIMAL(20,0) in Spark, on which ``hex`` overflows above 2^63. ``data_type``
    (``df.schema[name].dataType``) of a signed column takes the shorter way.
    """
    value = F.col(column) if isinstance(column, str) else column
    if isinstance(data_type, T.IntegralType):
        return F.lower(F.hex(value.cast("bigint")))
    return F.lower(F.conv(value.cast("string"), 10, 16))


def identifier_range_label(df: DataFrame, id_col: str = "identifier", name: str = "label") -> DataFrame:
    """One row naming the identifier set: first and last in hex, joined by ``,`` (under
    three identifiers) or ``...``; empty text for an empty set."""
    data_type = df.schema[id_col].dataType
    ends = df.select(id_col).distinct().agg(
        F.min(id_col).alias("first"), F.max(id_col).alias("last"), F.count(id_col).alias("n")
    )
    label = F.concat(
        hex_id("first", data_type),
        F.when(F.col("n") < 3, F.lit(",")).otherwise(F.lit("...")),
        hex_id("last", data_type),
    )
    return ends.select(F.coalesce(label, F.lit("")).alias(name))
