"""The physical plans are the ones meant for a large cluster."""

import contextlib
import io
import re
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
import sensorframe as sf

EPOCH = datetime(1970, 1, 1)

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return out.getvalue()


@pytest.fixture(scope="module")
def readings(spark):
    return entry.readings(spark, SF_DIR)


def exchanges(text):
    return re.findall(r"Exchange (\w+)", text)


def test_nothing_gathers_in_one_partition(spark, readings):
    for df in (
        sf.resample(readings, 60, 120, ("mean", "median")),
        sf.rolling(readings, 30, 1, ("mean", "median")),
        sf.series_bundle(readings, sf.SeriesSpec(rolling=("mean",))),
        sf.table_view(readings, [1], "value", "desc"),
        sf.index_table(readings, "value"),
        sf.profile_logs(readings),
        sf.catalog(readings),
        sf.dedup_logs(readings),
        sf.to_points(sf.source_series(readings)),
        sf.exclude_identifiers(readings, readings.where("value > 300")),
    ):
        # Besides aggregates without key, nothing may need a single partition.
        text = plan(df)
        for match in re.finditer("SinglePartition", text):
            assert "Limit" in text[: match.start()].splitlines()[-2], text


def test_exclusion_reaches_the_scan(spark):
    events = entry.events(spark, SF_DIR)
    text = plan(sf.exclude_identifiers(events, [1, 2, 3], "user_id"))
    assert re.search(r"PushedFilters: \[.*Not\(In\(user_id, \[1,2,3\]\)\)", text)


def test_only_needed_columns_are_read(spark, readings):
    text = plan(sf.resample(readings, 60, 60, id_col="identifier"))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in text
    text = plan(sf.distinct_identifiers(readings))
    assert "ReadSchema: struct<user_id:bigint>" in text


def test_resample_mean_combines_before_its_shuffle(readings):
    text = plan(sf.resample(readings, 60, 60))
    assert "partial_avg" in text
    assert exchanges(text) == ["hashpartitioning"]


def test_resample_with_median_shuffles_the_rows_once(readings):
    text = plan(sf.resample(readings, 60, 60, ("mean", "median")))
    assert exchanges(text) == ["hashpartitioning"]
    assert "ObjectHashAggregate" not in text


def test_sliding_windows_read_the_source_once(spark, readings):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the final plan at once
    try:
        for aggs in (("mean",), ("mean", "median")):
            text = plan(sf.resample(readings, 60, 600, aggs))
            # the other file read for medians is the written table of the series' first rows
            assert text.count("file:/root/testdata") == 1 and "Window" not in text and text.count("MapInArrow") == 1, text
            assert ("ReusedExchange" in text) == (aggs == ("mean",)), text
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_no_side_is_broadcast_by_a_hint(readings):
    split = sf.rolling(readings, 30, 1, "mean", hot_rows=5, chunk_rows=70)
    windows = sf.resample(readings, 60, 600, ("median",), hot_rows=2)
    for df in (split, windows):
        assert "ResolvedHint" not in df._jdf.queryExecution().analyzed().toString().replace("__sf_part", "")


def test_few_jobs_run_before_an_action(spark, readings):
    """Below hot_rows, one count of keys: its shuffle, (for medians) its written table, and a look whether a key is left."""
    context = spark.sparkContext
    runs = {
        "rolling": lambda: sf.rolling(readings, 30),
        "resample": lambda: sf.resample(readings, 60, 600, ("median",)),
    }
    for name, run in runs.items():
        context.setJobGroup(f"eager-{name}", "")
        run()
        context.setJobGroup("other", "")
        assert len(context.statusTracker().getJobIdsForGroup(f"eager-{name}")) <= (2 if name == "rolling" else 3)


def test_rolling_shuffles_once(readings):
    for size, aggs in ((30, "mean"), (5, ("mean", "median")), (30, ("mean", "median"))):
        text = plan(sf.rolling(readings, size, 1, aggs))
        assert exchanges(text) == ["hashpartitioning"] and text.count("MapInArrow") == 1


def test_sort_is_a_range_partitioning(readings):
    assert exchanges(plan(sf.sort_table(readings, "value"))) == ["rangepartitioning"]


def test_a_page_is_a_top_k(readings):
    assert "TakeOrderedAndProject" in plan(sf.page(readings, 100, 50))


def test_the_registry_is_broadcast_without_a_hint(spark):
    messages = spark.createDataFrame(
        [("sensors/atuc", 1, datetime(2024, 1, 1), b"")], sf.sources.messages.MESSAGES
    )
    for side in sf.route_topics(messages):
        assert "BroadcastHashJoin" in plan(side)


def test_latest_batch_is_limited_before_its_shuffle(spark):
    messages = spark.createDataFrame([], sf.sources.messages.MESSAGES)
    text = plan(sf.latest_batch_per_topic(messages))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_profile_combines_before_its_shuffle(readings):
    text = plan(sf.profile_logs(readings))
    assert "partial_min" in text and exchanges(text) == ["hashpartitioning"]


def odd_readings(spark):
    import random

    rng = random.Random(8)
    rows = [
        (rng.choice(["t", "p", None]), rng.choice([1, 2, 3, None]), rng.choice([None, *[EPOCH + timedelta(seconds=rng.randint(-9000, 9000))] * 8]),
         rng.choice([None, float("nan"), float("inf"), *[rng.randint(0, 99) / 4] * 9]), n)
        for n in range(700)
    ]
    rows += [("far", 1, datetime(1, 1, 1), 1.0, 900), ("far", 1, datetime(9998, 1, 1), 2.0, 901), ("far", 2, datetime(1, 1, 1), 3.0, 902), ("far", 2, datetime(9998, 1, 1), 4.0, 903)]
    rows += [("far", n, datetime(1 + n, 1, 1), 3.0, 1000 + n) for n in range(3, 60)] + [("far", n, datetime(9990, 1, 1), 5.0, 2000 + n) for n in range(3, 60)]
    return spark.createDataFrame(rows, "metric string, identifier bigint, ts timestamp_ntz, value double, seq bigint")


@pytest.mark.parametrize("every, period", [(60, 60), (60, 200), (300, 100)])
def test_a_bundle_made_at_once_equals_its_parts(spark, every, period):
    df = odd_readings(spark)
    both = ("mean", "median")
    for spec in (sf.SeriesSpec(both, every, period, both, 9, 3), sf.SeriesSpec(("median",), every, period), sf.SeriesSpec((), rolling=("mean",))):
        rounded = lambda b: b.withColumn("y", F.round("y", 9))
        at_once = rounded(sf.series_bundle(df, spec))
        apart = rounded(sf.series_bundle(df, spec, hot_rows=1))
        some = rounded(sf.series_bundle(df, spec, hot_rows=60))
        assert rows(at_once) == rows(apart) == rows(some)
        windows = sf.resample(df, every, period, spec.resampling) if spec.resampling else None
        if windows is not None:
            assert at_once.where("series = 'resampling_median'").count() == windows.count()


def test_a_bundle_takes_one_scan_and_one_shuffle(spark, tmp_path):
    odd_readings(spark).write.parquet(str(tmp_path / "log"))
    bundle = sf.series_bundle(spark.read.parquet(str(tmp_path / "log")), sf.SeriesSpec(("mean", "median"), rolling=("mean", "median")))
    bundle.collect()
    plan = bundle._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 1, plan


def test_a_bundle_of_nothing(spark):
    assert sf.series_bundle(odd_readings(spark).limit(0), sf.SeriesSpec(("mean",), rolling=("median",))).collect() == []
