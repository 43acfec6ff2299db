import importlib
import random
import statistics
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import Window, functions as F

import sensorframe as sf
from sensorframe.operators.rolling_kernel import rolling_batches

chunks_module = importlib.import_module("sensorframe.operators.chunks")

SCHEMA = "identifier bigint, ts timestamp_ntz, value double, seq bigint"
START = datetime(2024, 1, 1)


def frame(spark, points):
    """points: (identifier, second, value); seq is the place in the list."""
    data = [(i, None if s is None else START + timedelta(seconds=s), v, n) for n, (i, s, v) in enumerate(points)]
    return spark.createDataFrame(data, SCHEMA)


def random_points(seed, count=300):
    rng = random.Random(seed)
    return [
        # many equal times, nulls, and one identifier with most of the rows
        (rng.choice([7, 7, 7, 8, 9]), rng.randint(0, 60), rng.choice([None, rng.randint(0, 400) / 8]))
        for _ in range(count)
    ]


def expected(points, size, least):
    by_id = {}
    for seq, (i, s, v) in enumerate(points):
        by_id.setdefault(i, []).append((s, seq, v))
    out = {}
    for series in by_id.values():
        series.sort(key=lambda p: p[:2])
        for n, (_, seq, _) in enumerate(series):
            values = [v for _, _, v in series[max(0, n - size + 1) : n + 1] if v is not None]
            if len(values) < least:
                out[seq] = (None, None)
            else:
                out[seq] = (sum(values) / len(values), statistics.median(values))
    return out


def check(df, wanted):
    got = {r["seq"]: (r["rolling_mean"], r["rolling_median"]) for r in df.collect()}
    assert got.keys() == wanted.keys()
    for seq, pair in wanted.items():
        assert got[seq] == tuple(pytest.approx(x, abs=1.1e-6) for x in pair)


BOTH = ("mean", "median")


@pytest.mark.parametrize("size, least", [(1, 1), (2, 2), (5, 1), (30, 1), (30, 30), (1000, 3)])
def test_against_brute_force(spark, size, least):
    points = random_points(size)
    check(sf.rolling(frame(spark, points), size, least, BOTH), expected(points, size, least))


@pytest.fixture
def cuts(monkeypatch):
    """Records how identifiers were cut."""
    seen = []
    for name in ("_by_time", "_by_position"):
        original = getattr(chunks_module, name)

        def spy(*args, name=name, original=original):
            seen.append(name)
            return original(*args)

        monkeypatch.setattr(chunks_module, name, spy)
    return seen


# an identifier with crowded times goes by position, the others by time
@pytest.mark.parametrize("size, chunk", [(1, 10), (5, 7), (30, 16), (30, 100), (200, 10)])
def test_cutting_by_position_changes_nothing(spark, cuts, size, chunk):
    points = random_points(size + chunk) + [(7, 5, n / 4) for n in range(500)]
    split = sf.rolling(frame(spark, points), size, 1, BOTH, hot_rows=20, chunk_rows=chunk)
    check(split, expected(points, size, 1))
    assert cuts == ["_by_time", "_by_position"]


def spread_points(seed, count=1500):
    rng = random.Random(seed)
    return [
        # a steady identifier, a bursty one, one with a long pause, and small ones
        *[(1, n + rng.random(), rng.randint(0, 400) / 8) for n in range(count)],
        *[(2, n**1.3 / 9, rng.choice([None, n / 8])) for n in range(count)],
        *[(3, n + 2 * count * (n > count // 3), n / 8) for n in range(count)],
        *[(10 + n % 9, rng.uniform(0, 99), n / 8) for n in range(60)],
    ]


@pytest.mark.parametrize("size, chunk", [(1, 100), (5, 100), (30, 200), (90, 200), (300, 50)])
def test_cutting_by_time_changes_nothing(spark, cuts, size, chunk):
    points = spread_points(size)
    split = sf.rolling(frame(spark, points), size, 1, BOTH, hot_rows=200, chunk_rows=chunk)
    check(split, expected(points, size, 1))
    assert cuts == ["_by_time"]


def test_chunks_are_of_the_asked_size(spark):
    df = frame(spark, spread_points(0))
    cut = chunks_module.cut_identifiers(df, ["identifier"], ["ts", "seq"], 29, 200, 100)
    sizes = cut.groupBy("identifier", chunks_module.CHUNK).count()
    assert sizes.agg(F.max("count")).first()[0] <= 100 + 50 + 29 + 50
    assert cut.where(chunks_module.OWN).count() == df.count()
    assert chunks_module.cut_identifiers(df, ["identifier"], ["ts", "seq"], 29, 1500, 100) is None


@pytest.mark.parametrize("points", [spread_points(1), random_points(1) + [(7, 5, 0.25)] * 300])
def test_kernel_over_chunks(spark, points):
    split = sf.rolling(frame(spark, points), 40, 3, BOTH, hot_rows=100, chunk_rows=100)
    check(split, expected(points, 40, 3))


def test_kernel_carries_rows_between_steps():
    rng = random.Random(8)
    ids = sorted(rng.choice([1, 1, 1, 2, 3, 4]) for _ in range(3000))
    values = [rng.choice([None, rng.randint(0, 80) / 8]) for _ in ids]
    table = pa.table({"id": ids, "v": pa.array(values, pa.float64())})
    for size, least, batch in ((1, 1, 7), (5, 2, 3), (40, 3, 11), (500, 1, 100)):
        steps = rolling_batches(table.to_batches(batch), ["id"], "v", size, least, BOTH, step_rows=20)
        got = pa.Table.from_batches(steps).to_pydict()
        wanted = expected([(i, n, v) for n, (i, v) in enumerate(zip(ids, values))], size, least)
        assert got["id"] == ids
        for n in range(len(ids)):
            assert (got["rolling_mean"][n], got["rolling_median"][n]) == tuple(
                pytest.approx(x) for x in wanted[n]
            )


def test_odd_numbers_are_treated_like_spark_does(spark):
    odd = [float("nan"), float("inf"), float("-inf"), None, 1.0, 2.5, -0.0]
    rng = random.Random(3)
    points = [(1, n, rng.choice(odd + [float(n)] * 6)) for n in range(300)]
    df = frame(spark, points)
    window = Window.partitionBy("identifier").orderBy("ts", "seq").rowsBetween(-3, 0)
    values = F.sort_array(F.collect_list("value").over(window))
    low, high = (F.get(values, F.floor((F.size(values) - i) / 2).cast("int")) for i in (1, 0))
    n = F.count("value").over(window)
    median = F.when(F.size(values) % 2 == 1, low).otherwise((low + high) / 2)
    plain = df.select(
        "seq", F.when(n >= 2, F.round(F.avg("value").over(window), 6)), F.when(n >= 2, F.round(median, 6))
    )
    assert rows(sf.rolling(df, 4, 2, BOTH), "seq", "rolling_mean", "rolling_median") == rows(plain)


def test_the_mean_does_not_depend_on_what_else_is_asked_for(spark):
    rng = random.Random(5)
    points = [(1, n, 1e17 if n == 40 else rng.random()) for n in range(300)]
    df = frame(spark, points)
    assert rows(sf.rolling(df, 5), "seq", "rolling_mean") == rows(sf.rolling(df, 5, 1, BOTH), "seq", "rolling_mean")


def test_a_stray_date_stays_on_the_time_route(spark, cuts):
    points = [(1, n, n / 8) for n in range(1500)] + [(1, -1_700_000_000, 3.0)]
    check(sf.rolling(frame(spark, points), 5, 1, BOTH, hot_rows=200, chunk_rows=200), expected(points, 5, 1))
    assert cuts == ["_by_time"]


def test_series_of_different_metrics_never_meet(spark):
    points = frame(spark, [(1, 0, 1.0), (1, 1, 700.0), (1, 2, 3.0)])
    df = points.withColumn("metric", F.when(F.col("value") > 100, "turbidity").otherwise("temperature"))
    assert rows(sf.rolling(df, 3), "metric", "seq", "rolling_mean") == [("temperature", 0, 1.0), ("temperature", 2, 2.0), ("turbidity", 1, 700.0)]
    assert rows(sf.rolling(df, 3, id_col="identifier"), "seq", "rolling_mean")[1] == (1, 350.5)
    unnamed = df.withColumn("metric", F.nullif("metric", F.lit("turbidity")))
    assert rows(sf.rolling(unnamed, 3, hot_rows=1, chunk_rows=8), "seq", "rolling_mean") == [(0, 1.0), (1, 700.0), (2, 2.0)]


def test_one_aggregate_only(spark):
    df = frame(spark, random_points(1))
    assert sf.rolling(df, 3, 1, "mean").columns == ["identifier", "ts", "seq", "value", "rolling_mean"]
    assert sf.rolling(df, 3, 1, "median").columns[-1] == "rolling_median"


def test_rounds_half_away_from_zero(spark):
    points = [(1, 0, 0.0000005), (2, 0, -0.0000005), (3, 0, 1.00000049)]
    got = rows(sf.rolling(frame(spark, points), 1), "identifier", "rolling_mean")
    assert got == [(1, 0.000001), (2, -0.000001), (3, 1.0)]


def test_ties_follow_seq(spark):
    df = frame(spark, [(1, 0, 1.0), (1, 0, 5.0), (1, 0, 9.0)])
    assert rows(sf.rolling(df, 2), "seq", "rolling_mean") == [(0, 1.0), (1, 3.0), (2, 7.0)]


def test_rows_without_time_or_identifier_are_left_out(spark):
    df = frame(spark, [(1, 0, 1.0), (None, 0, 5.0), (1, None, 9.0)])
    assert rows(sf.rolling(df, 2), "seq") == [(0,)]


def test_window_of_one_is_the_value(spark):
    df = frame(spark, random_points(4))
    same = sf.rolling(df, 1, 1, BOTH).where(
        F.col("value").eqNullSafe(F.col("rolling_mean")) & F.col("value").eqNullSafe(F.col("rolling_median"))
    )
    assert same.count() == df.count()


@pytest.mark.parametrize(
    "bad",
    [{"window_size": 0}, {"min_periods": 0}, {"window_size": 3, "min_periods": 4}, {"aggs": ("sum",)}],
)
def test_arguments_are_checked(spark, bad):
    with pytest.raises(ValueError):
        sf.rolling(frame(spark, []), **bad)


def test_empty_input(spark):
    assert rows(sf.rolling(frame(spark, []))) == []
    assert rows(sf.rolling(frame(spark, []), 1000)) == []
