from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

import sensorframe as sf
from sensorframe.functions import instant_to_ntz, ntz_to_instant

EPOCH = datetime(1970, 1, 1)
TIMES = [
    datetime(1969, 12, 31, 23, 59, 59, 999999),
    datetime(1900, 1, 1, 0, 0, 0, 1),
    datetime(2024, 3, 10, 2, 30, 0, 123456),  # does not exist on a New York clock
    datetime(2024, 11, 3, 1, 30),  # exists twice there
    datetime(1970, 1, 1),
]


@pytest.fixture
def times(spark):
    return spark.createDataFrame([(t,) for t in TIMES] + [(None,)], "ts timestamp_ntz")


@pytest.mark.parametrize("tz", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_time_functions_ignore_the_session_zone(times, zone, tz):
    zone(tz)
    got = times.where("ts is not null").select(
        "ts",
        sf.epoch_us("ts").alias("us"),
        sf.epoch_ms("ts").alias("ms"),
        sf.from_epoch(sf.epoch_us("ts")).alias("back"),
        sf.format_ts("ts").alias("text"),
        sf.parse_ts(sf.format_ts("ts")).alias("parsed"),
        instant_to_ntz(ntz_to_instant("ts")).alias("instant"),
    )
    for row in got.collect():
        us = (row["ts"] - EPOCH) // timedelta(microseconds=1)
        assert row["us"] == us
        assert row["ms"] == pytest.approx(us / 1000, abs=1e-9)
        assert row["back"] == row["ts"] == row["instant"]
        assert row["text"] == row["ts"].strftime("%Y-%m-%d %H:%M:%S").replace("190-", "1900-")
        assert row["parsed"] == row["ts"].replace(microsecond=0)


def test_nulls_stay_null(times):
    row = times.where("ts is null").select(sf.epoch_us("ts"), sf.format_ts("ts"), sf.epoch_ms("ts")).first()
    assert tuple(row) == (None, None, None)


def test_display_zone(spark):
    df = spark.createDataFrame([(datetime(2024, 7, 1, 22, 0),)], "ts timestamp_ntz")
    fixed, named = df.select(sf.format_ts("ts", "+03:00"), sf.format_ts("ts", "Europe/Moscow")).first()
    assert fixed == named == "2024-07-02 01:00:00"


def test_from_epoch_units(spark):
    df = spark.createDataFrame([(-1,), (1_500,)], "n bigint")
    got = df.select(*[sf.from_epoch("n", unit).alias(unit) for unit in ("ns", "us", "ms")]).collect()
    assert tuple(got[0]) == (
        EPOCH - timedelta(microseconds=1),
        EPOCH - timedelta(microseconds=1),
        EPOCH - timedelta(milliseconds=1),
    )
    assert tuple(got[1]) == (
        EPOCH + timedelta(microseconds=1),
        EPOCH + timedelta(microseconds=1500),
        EPOCH + timedelta(milliseconds=1500),
    )
    with pytest.raises(ValueError):
        sf.from_epoch("n", "s")


def test_hex_of_signed_and_unsigned(spark):
    signed = spark.createDataFrame([(255,), (-1,), (None,)], "n bigint")
    assert [r[0] for r in signed.select(sf.hex_id("n")).collect()] == ["ff", "f" * 16, None]
    big = spark.createDataFrame([(str(2**63 + 5),), (str(2**64 - 1),)], "n string")
    big = big.select(F.col("n").cast("decimal(20,0)").alias("n"))
    got = [r[0] for r in big.select(sf.hex_id("n", big.schema["n"].dataType)).collect()]
    assert got == [f"{2**63 + 5:x}", f"{2**64 - 1:x}"]


@pytest.mark.parametrize(
    "ids, label",
    [([], ""), ([10], "a,a"), ([10, 255, 10], "a,ff"), ([3, 10, 255, None], "3...ff")],
)
def test_identifier_range_label(spark, ids, label):
    df = spark.createDataFrame([(i,) for i in ids], "identifier bigint")
    assert rows(sf.identifier_range_label(df)) == [(label,)]
