"""Time functions on TIMESTAMP_NTZ that never look at the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

DAY_US = 86_400_000_000
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
_MICROSECOND = "interval '0.000001' second"
YMD_HMS = "yyyy-MM-dd HH:mm:ss"


def _col(column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def utc_session(spark: SparkSession) -> bool:
    """Whether wall clock and instant are the same in this session."""
    return spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def epoch_us(column, utc: bool = False) -> Column:
    """Whole microseconds since 1970, negative before it.

    ``utc=True`` (see ``utc_session``) allows the cheaper cast through an
    instant, which is exact in a UTC session only; operators use it on frames
    they analyse at once, so a later change of the zone cannot reach them.
    """
    ts = _col(column)
    if utc:
        return F.unix_micros(ts.cast("timestamp"))
    day = ts.cast("date")
    within_day = ts - day.cast("timestamp_ntz")
    # below one day, so the product stays far inside the interval range
    return F.unix_date(day).cast("bigint") * F.lit(DAY_US) + (within_day * F.lit(1_000_000)).cast(
        "interval second"
    ).cast("bigint")


def epoch_ms(column, utc: bool = False) -> Column:
    """Milliseconds since 1970 as a double, the X axis of a series."""
    return epoch_us(column, utc) / F.lit(1000.0)


def from_epoch(column, unit: str = "us", utc: bool = False) -> Column:
    """Integer epoch in ``ns``, ``us`` or ``ms`` to TIMESTAMP_NTZ."""
    epoch = _col(column).cast("bigint")
    if unit == "ns":
        # subtracting the remainder first floors before 1970 too
        epoch = F.call_function("div", epoch - F.pmod(epoch, F.lit(1000)), F.lit(1000))
    elif unit == "ms":
        epoch = epoch * F.lit(1000)
    elif unit != "us":
        raise ValueError(f"unit must be ns, us or ms, got {unit!r}")
    if utc:
        return F.timestamp_micros(epoch).cast("timestamp_ntz")
    return F.expr(_EPOCH) + F.expr(_MICROSECOND) * epoch


def instant_to_ntz(column) -> Column:
    """TIMESTAMP (an instant) to its UTC wall clock."""
    return from_epoch(F.unix_micros(_col(column)), "us")


def ntz_to_instant(column) -> Column:
    """TIMESTAMP_NTZ read as UTC, as an instant; event time of a stream."""
    return F.timestamp_micros(epoch_us(column))


def format_ts(column, tz: str | None = None) -> Column:
    """``yyyy-MM-dd HH:mm:ss``; ``tz`` shifts from UTC by that zone or fixed offset first."""
    ts = _col(column)
    if tz is not None:
        ts = F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)
    return F.substring(ts.cast("string"), 1, 19)


def parse_ts(column) -> Column:
    """Text ``yyyy-MM-dd HH:mm:ss`` to TIMESTAMP_NTZ."""
    return F.to_timestamp_ntz(_col(column), F.lit(YMD_HMS))
