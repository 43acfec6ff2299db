"""Table view operators: exclude identifiers, sort, number and page rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import require_columns
from .rowindex import with_row_index

# Beyond this many leading rows a page is cut out of a numbered table instead
# of being gathered by a top-k.
TOP_K_ROWS = 100_000


def distinct_identifiers(df: DataFrame, id_col: str = "identifier") -> DataFrame:
    """Distinct non-null identifiers."""
    return df.where(F.col(id_col).isNotNull()).select(id_col).distinct()


def exclude_identifiers(df: DataFrame, identifiers, id_col: str = "identifier") -> DataFrame:
    """Rows whose identifier is none of ``identifiers``.

    ``identifiers`` is a list (one predicate, pushed down to Parquet), a frame
    with the column ``id_col`` (anti join), or ``"all"``. As soon as anything
    is excluded, rows without identifier go too; an empty list changes nothing.
    """
    require_columns(df, id_col)
    known = F.col(id_col).isNotNull()
    if isinstance(identifiers, DataFrame):
        chosen = identifiers.where(known).select(id_col).distinct()
        kept = df.join(chosen, id_col, "left_anti").select(*df.columns)
        return kept.where(known | ~chosen.select(F.lit(1).alias("one")).limit(1).exists())
    if isinstance(identifiers, str):
        if identifiers != "all":
            raise ValueError(f"identifiers must be a list, a frame or 'all', got {identifiers!r}")
        any_known = df.where(known).select(F.lit(1).alias("one")).limit(1)
        return df.where(~known & ~any_known.exists())
    chosen = [value for value in identifiers if value is not None]
    return df.where(~F.col(id_col).isin(chosen)) if chosen else df


def sort_order(by: str, order: str = "asc", seq_col: str | None = "seq") -> list[Column]:
    """Ascending puts nulls first, descending nulls last; ties follow ``seq_col``."""
    if order not in ("asc", "desc"):
        raise ValueError(f"order must be 'asc' or 'desc', got {order!r}")
    key = F.col(by).asc_nulls_first() if order == "asc" else F.col(by).desc_nulls_last()
    return [key] + ([F.col(seq_col).asc()] if seq_col and seq_col != by else [])


def sort_table(df: DataFrame, by: str = "ts", order: str = "asc", *, seq_col: str | None = "seq") -> DataFrame:
    """Rows in total order by one column."""
    require_columns(df, by)
    return df.orderBy(*sort_order(by, order, seq_col))


def index_table(
    df: DataFrame, by: str = "ts", order: str = "asc", *, seq_col: str | None = "seq", name: str = "row_index"
) -> DataFrame:
    """Rows with their 0-based position in the sorted table."""
    require_columns(df, by)
    return with_row_index(df, *sort_order(by, order, seq_col), name=name)


def page(
    df: DataFrame,
    offset: int,
    limit: int,
    by: str = "ts",
    order: str = "asc",
    *,
    seq_col: str | None = "seq",
) -> DataFrame:
    """``limit`` rows of the sorted table from position ``offset``, in order."""
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    require_columns(df, by)
    if offset + limit <= TOP_K_ROWS:
        return df.orderBy(*sort_order(by, order, seq_col)).offset(offset).limit(limit)
    at = F.col("__sf_at")
    numbered = index_table(df, by, order, seq_col=seq_col, name="__sf_at")
    return numbered.where((at >= offset) & (at < offset + limit)).orderBy(at).drop("__sf_at")
