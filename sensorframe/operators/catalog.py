"""Catalog of logs: profile, order, fingerprint, de-duplicate, select, merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.time import format_ts, parse_ts
from ..schema import require_columns
from ..scratch import pin
from .rowindex import with_row_index

LOG = ["path", "file", "metric"]


def profile_logs(readings: DataFrame) -> DataFrame:
    """One row per log: time range as text, rows, columns, rows without time or identifier.

    The range is null when a log has no timestamp.
    """
    return _described(readings.groupBy(*LOG).agg(*_profile(readings)))


def profile_and_print(readings: DataFrame) -> DataFrame:
    """``profile_logs`` with the ``fingerprint`` of ``fingerprint_logs``, in one pass."""
    columns = [c for c in readings.columns if c not in LOG]
    hashed = readings.withColumn("h", _row_hash(columns))
    profiled = hashed.groupBy(*LOG).agg(*_profile(readings), _fingerprint().alias("fingerprint"))
    return _described(profiled, "fingerprint")


def _profile(readings: DataFrame) -> list[Column]:
    require_columns(readings, *LOG, "ts", "identifier")
    width = F.max("width") if "width" in readings.columns else F.lit(len(readings.columns))
    return [
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
        F.count(F.lit(1)).alias("rows"),
        width.cast("int").alias("columns"),
        F.count_if(F.col("ts").isNull()).alias("null_ts"),
        F.count_if(F.col("identifier").isNull()).alias("null_id"),
    ]


def _described(profiled: DataFrame, *more: str) -> DataFrame:
    ends = [format_ts("first").alias("min_ts"), format_ts("last").alias("max_ts")]
    return profiled.select(*LOG, *ends, "rows", "columns", "null_ts", "null_id", *more)


def catalog(readings: DataFrame) -> DataFrame:
    """Profiles ordered by metric name, first and last time, with their ``position``."""
    return with_row_index(profile_logs(readings), "metric", "min_ts", "max_ts", "file", "path", name="position")


def merge_profile(profiles: DataFrame, files=None) -> DataFrame:
    """One row for the union of the chosen logs of a ``catalog``: the widest time range (whole
    seconds), all rows, and the name of the last log in catalog order. No file name.

    ``ValueError`` if nothing is chosen, by an empty list or frame or by names that no log has.
    """
    require_columns(profiles, "position", "min_ts", "max_ts", "metric", "rows")
    chosen = select_logs(profiles, files)
    if files is not None and chosen.isEmpty():
        raise ValueError("nothing selected to merge")
    return chosen.agg(
        F.max_by("metric", "position").alias("metric"),
        F.min(parse_ts("min_ts")).alias("first"),
        F.max(parse_ts("max_ts")).alias("last"),
        F.sum("rows").alias("rows"),
    ).select("metric", format_ts("first").alias("min_ts"), format_ts("last").alias("max_ts"), "rows")


def select_logs(df: DataFrame, files=None) -> DataFrame:
    """Rows of the chosen logs: ``None`` = all, an empty list = none; a list or a frame with ``file``."""
    require_columns(df, "file")
    if files is None:
        return df
    if isinstance(files, DataFrame):
        return df.join(files.select("file").distinct(), "file", "left_semi").select(*df.columns)
    return df.where(F.col("file").isin(list(files)))


def drop_logs(df: DataFrame, files=None) -> DataFrame:
    """Rows of all logs but the chosen ones: ``None`` drops every log, an empty list none."""
    require_columns(df, "file")
    if files is None:
        return df.limit(0)
    if isinstance(files, DataFrame):
        return df.join(files.select("file").distinct(), "file", "left_anti").select(*df.columns)
    files = list(files)
    return df.where(~F.coalesce(F.col("file").isin(files), F.lit(False))) if files else df


def _row_hash(columns: list[str]) -> Column:
    # A null leaves the running hash as it was, so its place is hashed as well.
    return F.xxhash64(*[part for name in columns for part in (F.col(name), F.col(name).isNull())])


def _fingerprint() -> Column:
    # Sums of 16-bit quarters stay exact up to 10^14 rows in one log.
    quarters = [F.sum(F.shiftrightunsigned("h", bits).bitwiseAND(F.lit(0xFFFF))) for bits in (48, 32, 16, 0)]
    return F.concat_ws("-", *map(F.hex, [F.count(F.lit(1)), *quarters, F.bit_xor("h")]))


def fingerprint_logs(
    readings: DataFrame, columns: list[str] | None = None, log_cols: tuple[str, ...] = tuple(LOG)
) -> DataFrame:
    """Content fingerprint per log, from the multiset of its rows: equal logs get equal values
    whatever the order in which Spark delivers their rows.

    Every cell counts, whatever its column, but for the columns that name the log. ``log_cols`` says what a log is:
    on ``read_raw_logs`` it is ``("_path", "_file")``.
    """
    log_cols = list(log_cols)
    columns = columns or [c for c in readings.columns if c not in log_cols]
    require_columns(readings, *log_cols, *columns)
    return (
        readings.select(*log_cols, _row_hash(columns).alias("h"))
        .groupBy(*log_cols)
        .agg(F.count(F.lit(1)).alias("rows"), _fingerprint().alias("fingerprint"))
    )


def dedup_logs(
    readings: DataFrame, by_name: bool = True, *, log_cols: tuple[str, ...] = tuple(LOG), name_col: str = "file"
) -> DataFrame:
    """Keep one of several equal logs (the first path).

    Equal means equal in every cell, of one metric where there is such a column, and, with ``by_name``, of one file
    name. The first of ``log_cols`` is the path. The fingerprints, one row per log, are written first: their size on
    disk then decides between a broadcast and a shuffle.
    """
    path, *_ = log_cols
    more = [c for c in log_cols if c not in (path, name_col)]
    prints = pin(fingerprint_logs(readings, log_cols=log_cols), "fingerprints")
    groups = [*([name_col] if by_name else []), *more, "rows", "fingerprint"]
    kept = prints.groupBy(*groups).agg(F.min(path).alias("__sf_path"))
    kept = kept.select("__sf_path", *[F.col(c).alias(f"__sf_{c}") for c in more])
    same = F.col(path).eqNullSafe(F.col("__sf_path"))
    for c in more:
        same &= F.col(c).eqNullSafe(F.col(f"__sf_{c}"))
    return readings.join(kept, same, "left_semi")


def union_logs(*logs: DataFrame, strict: bool = True) -> DataFrame:
    """Stack logs, duplicates kept. ``strict`` demands equal names, order and types, because a
    plain union would coerce them silently; otherwise columns are matched by name."""
    if not logs:
        raise ValueError("nothing to union")
    if strict:
        expected = [(f.name, f.dataType) for f in logs[0].schema.fields]
        for log in logs[1:]:
            found = [(f.name, f.dataType) for f in log.schema.fields]
            if found != expected:
                raise ValueError(f"schema mismatch: {expected} and {found}")
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=not strict), logs)
