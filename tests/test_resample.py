import math
import random
import statistics
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

import sensorframe as sf

EPOCH = datetime(1970, 1, 1)
SCHEMA = "identifier bigint, ts timestamp_ntz, value double, seq bigint"


def at(seconds):
    return EPOCH + timedelta(seconds=seconds)


def frame(spark, points):
    return spark.createDataFrame(
        [(i, None if s is None else at(s), v, n) for n, (i, s, v) in enumerate(points)], SCHEMA
    )


def expected(points, every, period, leading="drop"):
    by_id = defaultdict(list)
    for i, s, v in points:
        if i is not None and s is not None:
            by_id[i].append((s, v))
    out = {}
    for i, series in by_id.items():
        first = math.floor(min(s for s, _ in series) / every) * every
        for s, v in series:
            start = math.floor(s / every) * every
            while start > s - period:
                if start <= s and (leading == "keep" or start >= first):
                    out.setdefault((i, at(start)), []).append(v)
                start -= every
    result = []
    for (i, start), values in out.items():
        values = [v for v in values if v is not None]
        mean = sum(values) / len(values) if values else None
        result.append((i, start, mean, statistics.median(values) if values else None))
    return result


def assert_same(df, wanted):
    got = {(r[0], r[1]): (r["mean"], r["median"]) for r in df.collect()}
    assert set(got) == {(i, t) for i, t, _, _ in wanted}
    for i, t, mean, median in wanted:
        assert got[i, t] == (pytest.approx(mean), pytest.approx(median))


DRAWING = [(1, 30 * n, float(n * n)) for n in range(9)]  # a point every half minute


@pytest.mark.parametrize(
    "every, period, starts",
    [
        (60, 60, [0, 60, 120, 180, 240]),
        (60, 120, [0, 60, 120, 180, 240]),
        (120, 60, [0, 120, 240]),
    ],
)
def test_tumbling_sliding_and_gapped(spark, every, period, starts):
    windows = sf.resample(frame(spark, DRAWING), every, period, ("mean", "median"))
    assert sorted(r[0] for r in rows(windows, "ts")) == [at(s) for s in starts]
    assert_same(windows, expected(DRAWING, every, period))


def test_windows_are_closed_left_open_right(spark):
    points = [(1, 0, 1.0), (1, 60, 3.0), (1, 119.999999, 5.0), (1, 120, 100.0)]
    got = rows(sf.resample(frame(spark, points), 60, 60))
    assert got == [(1, at(0), 1.0), (1, at(60), 4.0), (1, at(120), 100.0)]


def test_before_1970_floors(spark):
    points = [(1, -1, 1.0), (1, -60, 3.0), (1, -61, 10.0)]
    assert rows(sf.resample(frame(spark, points), 60, 60)) == [(1, at(-120), 10.0), (1, at(-60), 2.0)]


def test_nulls(spark):
    points = [(1, 0, None), (1, 60, 2.0), (1, 61, None), (None, 60, 9.0), (1, None, 9.0)]
    windows = sf.resample(frame(spark, points), 60, 60, ("mean", "median"))
    assert rows(windows) == [(1, at(0), None, None), (1, at(60), 2.0, 2.0)]


def test_nan_is_the_largest_value(spark):
    points = [(1, 0, float("nan")), (1, 1, 1.0), (1, 2, 2.0)]
    assert rows(sf.resample(frame(spark, points), 60, 60, ("mean", "median"))) == [(1, at(0), "nan", 2.0)]


def test_leading_windows(spark):
    points = [(1, 600, 1.0), (2, 660, 2.0)]
    dropped = rows(sf.resample(frame(spark, points), 60, 180))
    assert dropped == [(1, at(600), 1.0), (2, at(660), 2.0)]
    kept = rows(sf.resample(frame(spark, points), 60, 180, leading="keep"))
    assert sorted((i, t) for i, t, _ in kept) == [
        (1, at(480)), (1, at(540)), (1, at(600)), (2, at(540)), (2, at(600)), (2, at(660)),
    ]


def random_points(seed, count=400):
    rng = random.Random(seed)
    return [
        (rng.choice([1, 1, 1, 2, 3]), rng.uniform(-4000, 4000), rng.choice([None, rng.randint(0, 50) / 4]))
        for _ in range(count)
    ]


SHAPES = [(60, 60), (60, 120), (100, 250), (300, 100), (50, 450), (7, 1000), (1, 86400)]


@pytest.mark.parametrize("every, period", SHAPES[:-1])
@pytest.mark.parametrize("leading", ["drop", "keep"])
def test_against_brute_force(spark, every, period, leading):
    points = random_points(every)
    df = frame(spark, points)
    wanted = expected(points, every, period, leading)
    assert_same(sf.resample(df, every, period, ("mean", "median"), leading), wanted)
    means = sf.resample(df, every, period, "mean", leading)
    assert_same(means.withColumn("median", F.lit(None)), [(i, t, m, None) for i, t, m, _ in wanted])


@pytest.mark.parametrize("every, period", [(60, 60), (60, 120), (300, 100)])
def test_splitting_large_windows_changes_nothing(spark, every, period):
    points = random_points(5) + [(1, 30 + n / 1000, float(n % 7)) for n in range(300)]
    df = frame(spark, points)
    split = sf.resample(df, every, period, ("mean", "median"), hot_rows=20)
    assert_same(split, expected(points, every, period))


def test_all_null_large_window(spark):
    points = [(1, n, None) for n in range(30)] + [(2, n, 1.0) for n in range(5)]
    split = sf.resample(frame(spark, points), 60, 60, ("mean", "median"), hot_rows=10)
    assert rows(split) == [(1, at(0), None, None), (2, at(0), 1.0, 1.0)]


def test_kept_leading_windows_equal_spark_windows(spark):
    df = frame(spark, random_points(9))
    ours = sf.resample(df, 60, 180, leading="keep").select("identifier", "ts", F.round("mean", 9))
    theirs = (
        df.where("identifier is not null")
        .groupBy("identifier", F.window(F.col("ts"), "180 seconds", "60 seconds").alias("w"))
        .agg(F.round(F.avg("value"), 9))
        .selectExpr("identifier", "w.start", "`round(avg(value), 9)`")
    )
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("tz", ["America/New_York"])
def test_session_zone_does_not_matter(spark, zone, tz):
    points = [(1, 1710037800 + n * 1800, float(n)) for n in range(6)]
    wanted = expected(points, 3600, 7200)
    zone(tz)
    assert_same(sf.resample(frame(spark, points), 3600, 7200, ("mean", "median")), wanted)


def test_empty_input(spark):
    assert rows(sf.resample(frame(spark, []), aggs=("mean", "median"))) == []


def test_arguments_are_checked(spark):
    df = frame(spark, DRAWING)
    for bad in (
        {"every_s": 0},
        {"period_s": -1},
        {"every_s": 1.5},
        {"aggs": ()},
        {"aggs": ("mode",)},
        {"leading": "maybe"},
        {"value_col": "nothing"},
    ):
        with pytest.raises(ValueError):
            sf.resample(df, **bad)


def test_many_windows_per_row_warn(spark):
    with pytest.warns(UserWarning):
        windows = sf.resample(frame(spark, [(1, 5000, 1.0)]), 1, 2000, leading="keep")
    assert windows.count() == 2000


def test_unsigned_identifiers(spark):
    big = frame(spark, DRAWING).withColumn("identifier", F.lit(str(2**64 - 1)).cast("decimal(20,0)"))
    assert rows(sf.resample(big, 120, 120, ("median",)).select(sf.hex_id("identifier", big.schema["identifier"].dataType)))[0] == ("f" * 16,)


def test_means_hold_odd_numbers_only_in_their_windows(spark):
    odd = {30: float("inf"), 31: float("-inf"), 60: float("nan"), 90: 1e17}
    points = [(1, n, odd.get(n, n / 8)) for n in range(150)]
    got = {t: (m, d) for _, t, m, d in rows(sf.resample(frame(spark, points), 1, 7, ("mean", "median"), "keep"))}
    for start in range(-6, 150):
        values = [v for _, n, v in points if start <= n < start + 7]
        mean, median = got[at(start)]
        wanted = sum(values) / len(values)
        assert (mean == "nan") if math.isnan(wanted) else mean == pytest.approx(wanted, rel=1e-12)
        ordered = sorted(values, key=lambda v: (math.isnan(v), v))
        low, high = ordered[(len(values) - 1) // 2], ordered[len(values) // 2]
        middle = low if low == high else (low + high) / 2
        assert (median == "nan") if math.isnan(middle) else median == pytest.approx(middle)


def test_metrics_never_share_a_window(spark):
    df = frame(spark, [(1, 0, 1.1), (1, 1, 700.0)]).withColumn("metric", F.when(F.col("value") > 9, "turbidity").otherwise("temperature"))
    assert rows(sf.resample(df, 60, 120, leading="keep"), "metric", "mean") == [("temperature", 1.1)] * 2 + [("turbidity", 700.0)] * 2
    assert rows(sf.resample(df, 60, 60, id_col="identifier"), "mean") == [(350.55,)]
    assert sf.resample(df, 60, 60).columns == ["metric", "identifier", "ts", "mean"]


def test_many_windows_per_row_cost_no_rows(spark):
    """40,000 rows of one sensor, 900 windows each."""
    points = [(1, n / 10, float(n % 97)) for n in range(40_000)]
    df = frame(spark, points)
    got = sf.resample(df, 1, 900, ("mean", "median"))
    assert got.count() == 4000
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString().replace("Generate explode(CASE", "")
    values = [p[2] for p in points]
    row = got.where(F.col("ts") == F.lit(at(1000)).cast("timestamp_ntz")).first()
    part = sorted(values[10_000:19_000])
    assert row["mean"] == pytest.approx(sum(part) / 9000) and row["median"] == (part[4499] + part[4500]) / 2


@pytest.mark.parametrize("every, period, bin_rows", [(60, 60, 7), (60, 120, 1), (100, 250, 7), (300, 100, 3), (7, 1000, 20)])
def test_medians_of_hot_blocks_by_selection(spark, every, period, bin_rows):
    points = random_points(every + 1, 300)
    odd = {3: float("nan"), 50: float("inf"), 90: float("-inf")}
    points = [(i, s, odd.get(n, v)) for n, (i, s, v) in enumerate(points)]
    df = frame(spark, points)
    for leading in ("drop", "keep"):
        split = sf.resample(df, every, period, ("median", "mean"), leading, hot_rows=5, bin_rows=bin_rows)
        whole = sf.resample(df, every, period, ("median", "mean"), leading)
        assert split.columns == whole.columns
        assert rows(split.withColumn("mean", F.round("mean", 9))) == rows(whole.withColumn("mean", F.round("mean", 9)))


def rows_shuffled(spark, work):
    """Rows that all stages of ``work`` wrote to exchanges."""
    gateway = spark.sparkContext._gateway
    store, listing = spark.sparkContext._jsc.sc().statusStore(), gateway.jvm.java.util.ArrayList

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(listing(), False, False, gateway.new_array(gateway.jvm.double, 0), listing())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    work()
    return sum(n for stage, n in stages().items() if stage not in before)


def test_a_hot_block_of_a_thousand_windows_shuffles_each_row_less_than_twice(spark):
    rng = random.Random(3)
    points = [(1, n / 10, rng.gauss(20, 3) + n % 5) for n in range(60_000)]
    df = frame(spark, points).cache()
    df.count()
    got = []
    moved = rows_shuffled(spark, lambda: got.extend(sf.resample(df, 1, 1000, ("median",), hot_rows=10_000, bin_rows=5000).collect()))
    assert moved < 2 * len(points) + 20 * len(got)
    assert len(got) == 6000
    medians = {r.ts: r.median for r in got}
    for start in (0, 17, 2500, 5400, 5999):
        values = [v for _, s, v in points if start <= s < start + 1000]
        assert medians[at(start)] == statistics.median(values)


def test_a_longer_window_costs_the_median_kernel_no_more_time():
    import time

    import pyarrow as pa

    from sensorframe.operators.resample_kernel import window_batches

    def spent(period):
        us = [n * 25_000 for n in range(40_000)]
        batch = pa.RecordBatch.from_pydict({"identifier": [1] * len(us), "block": [0] * len(us), "us": us, "v": [float(n * 7919 % 1000) for n in range(len(us))]})
        begin = time.perf_counter()
        out = pa.Table.from_batches(window_batches([batch], ["identifier"], 1_000_000, period * 1_000_000, 4 * 900_000_000, ("median",)))
        assert len(out) >= 1000
        return time.perf_counter() - begin

    spent(100)
    assert spent(800) < 3 * spent(100) + 0.2


def test_means_shuffle_panes_not_rows(spark):
    points = [(i, n / 50, float(n % 97)) for i in range(2) for n in range(30_000)]
    df = frame(spark, points).cache()
    df.count()
    for leading in ("drop", "keep"):
        moved = rows_shuffled(spark, lambda: assert_means(spark, df, points, leading))
        assert moved < 400


def assert_means(spark, df, points, leading):
    got = {(r.identifier, r.ts): r["mean"] for r in sf.resample(df, 60, 120, leading=leading).collect()}
    wanted = expected(points, 60, 120, leading)
    assert len(got) == len(wanted) and all(got[i, t] == pytest.approx(m) for i, t, m, _ in wanted)


def test_one_scan_and_one_kernel_for_sliding_means(spark, tmp_path):
    frame(spark, random_points(4)).write.parquet(str(tmp_path / "log"))
    windows = sf.resample(spark.read.parquet(str(tmp_path / "log")), 60, 120)
    windows.collect()
    plan = windows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and plan.count("Scan parquet") == 1, plan
    both = sf.resample(spark.read.parquet(str(tmp_path / "log")), 60, 120, ("mean", "median"))
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1 and plan.count("ReusedExchange") == 0, plan
