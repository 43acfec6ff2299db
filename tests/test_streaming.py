from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

import sensorframe as sf
from test_messages import GOOD, SMALL, TWO, payload

START = datetime(2024, 1, 1)
POINTS = "identifier bigint, ts timestamp_ntz, value double, seq bigint"


def land(spark, folder, *files, schema=POINTS):
    """One Parquet file per list, landing one after the other."""
    for data in files:
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(folder))


def source(spark, folder, schema=POINTS):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(stream, out):
    (
        stream.writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def points(numbers, value=float):
    return [(n % 3, START + timedelta(seconds=20 * n), value(n % 17), n) for n in numbers]


@pytest.mark.parametrize("every, period", [(60, 60), (60, 180), (120, 60)])
def test_resample_stream_equals_batch_for_closed_windows(spark, tmp_path, every, period):
    files = [points(range(0, 200)), points(range(200, 400)), points(range(400, 600))]
    land(spark, tmp_path / "in", *files)
    stream = sf.resample_stream(source(spark, tmp_path / "in"), every, period, ("mean", "median"), "1 minute")
    got = run(stream, tmp_path)
    batch = spark.createDataFrame([p for f in files for p in f], POINTS)
    wanted = sf.resample(batch, every, period, ("mean", "median"), leading="keep")
    closed = START + timedelta(seconds=20 * 599 - 60 - max(every, period))
    assert rows(got) == rows(wanted.where(F.col("ts") <= F.lit(closed)))
    assert got.count() > 100


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    late = [(0, START, 1000.0, 9999)]
    land(spark, tmp_path / "in", points(range(0, 300)), points(range(300, 600)), late, points(range(600, 601)))
    got = run(sf.resample_stream(source(spark, tmp_path / "in"), 60, 60, "mean", "1 minute"), tmp_path)
    first = got.where(F.col("ts") == F.lit(START)).where("identifier = 0").collect()
    assert [r["mean"] for r in first] == [0.0]


@pytest.mark.parametrize("size, least", [(1, 1), (5, 2), (30, 30)])
def test_rolling_stream_equals_batch_for_ordered_input(spark, tmp_path, size, least):
    value = lambda n: None if n == 4 else float(n)
    files = [points(range(a, a + 100), value) for a in (0, 100, 200)]
    files = [list(reversed(f)) for f in files]  # order inside a file does not matter
    land(spark, tmp_path / "in", *files)
    got = run(sf.rolling_stream(source(spark, tmp_path / "in"), size, least, ("mean", "median")), tmp_path)
    batch = spark.createDataFrame([p for f in files for p in f], POINTS)
    assert got.where("late").count() == 0
    assert rows(got.drop("late")) == rows(sf.rolling(batch, size, least, ("mean", "median")))


def test_rolling_stream_flags_late_rows(spark, tmp_path):
    land(spark, tmp_path / "in", points(range(50, 100)), points([10, 11]) + points(range(100, 120)))
    got = run(sf.rolling_stream(source(spark, tmp_path / "in"), 3), tmp_path)
    assert got.count() == 72
    assert rows(got.where("late"), "seq", "rolling_mean") == [(10, None), (11, None)]
    on_time = points(range(50, 120))
    batch = sf.rolling(spark.createDataFrame(on_time, POINTS), 3)
    assert rows(got.where("not late").drop("late")) == rows(batch)


MESSAGE = "topic string, message_id bigint, arrived timestamp_ntz, payload binary"


def message(topic, number, content):
    return (topic, number, START + timedelta(minutes=number), content)


FIRST = [
    message("sensors/dtec", 1, GOOD),
    message("sensors/atuc", 2, SMALL),
    message("sensors/ddoc/t1", 3, GOOD),
    message("elsewhere", 4, GOOD),
]
SECOND = [message("sensors/dtec", 5, TWO), message("sensors/atuc", 6, b"broken")]


def inbox(spark, tmp_path):
    land(spark, tmp_path / "in", FIRST, SECOND, schema=MESSAGE)
    return sf.message_stream(spark, str(tmp_path / "in"), files_per_trigger=1)


def test_ingest(spark, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        stream = inbox(spark, tmp_path) if not (tmp_path / "out").exists() else sf.message_stream(
            spark, str(tmp_path / "in"), files_per_trigger=1
        )
        sf.ingest_stream(stream, out, f"{out}/checkpoint", available_now=True).awaitTermination()
    stored = spark.read.parquet(f"{out}/readings")
    assert rows(stored.where("error is null"), "topic", "message_id", "row") == [
        ("sensors/atuc", 2, 0),
        ("sensors/dtec", 1, 0),
        ("sensors/dtec", 1, 1),
        ("sensors/dtec", 5, 0),
    ]
    assert rows(stored.where("error is not null"), "message_id") == [(6,)]
    assert rows(spark.read.parquet(f"{out}/dead_letters"), "message_id") == [(3,)]


def test_a_repeated_micro_batch_replaces_its_own_output(spark, tmp_path):
    out = str(tmp_path / "out")
    stream = inbox(spark, tmp_path)
    sf.ingest_stream(stream, out, f"{out}/one", available_now=True).awaitTermination()
    again = sf.message_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    sf.ingest_stream(again, out, f"{out}/two", available_now=True).awaitTermination()
    assert spark.read.parquet(f"{out}/readings").count() == 5


def test_latest_keeps_the_newest_readable_batch(spark, tmp_path):
    out = str(tmp_path / "out")
    sf.latest_stream(inbox(spark, tmp_path), out, f"{tmp_path}/c", available_now=True).awaitTermination()
    assert rows(spark.read.parquet(f"{out}/rows"), "topic", "message_id", "row") == [
        ("sensors/atuc", 2, 0),
        ("sensors/dtec", 5, 0),
    ]
    letters = spark.read.parquet(f"{out}/dead_letters")
    assert rows(letters.where("payload is not null and error is not null"), "message_id") == [(3,), (6,)]


def test_an_older_message_never_replaces_a_newer_one(spark, tmp_path):
    out = str(tmp_path / "out")
    batches = [message("sensors/dtec", 9, TWO)], [message("sensors/dtec", 1, GOOD)], [message("sensors/dtec", 9, TWO)]
    land(spark, tmp_path / "in", *batches, schema=MESSAGE)
    stream = sf.message_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    sf.latest_stream(stream, out, f"{tmp_path}/c", available_now=True).awaitTermination()
    assert rows(spark.read.parquet(f"{out}/rows"), "message_id", "row") == [(9, 0)]


def test_append_keeps_every_row(spark, tmp_path):
    out = str(tmp_path / "out")
    sf.append_readings_stream(inbox(spark, tmp_path), out, f"{tmp_path}/c", available_now=True).awaitTermination()
    stored = spark.read.parquet(out)
    assert rows(stored.where("outcome = 'reading'"), "topic", "message_id") == [
        ("sensors/atuc", 2),
        ("sensors/dtec", 1),
        ("sensors/dtec", 1),
        ("sensors/dtec", 5),
    ]
    letters = stored.where("outcome = 'dead_letter' and payload is not null and error is not null")
    assert rows(letters, "topic", "message_id") == [("sensors/atuc", 6), ("sensors/ddoc/t1", 3)]


def test_rolling_stream_takes_a_null_tie_breaker(spark, tmp_path):
    first = [(i, ts, v, None) for i, ts, v, _ in points(range(20))]
    second = [(i, ts, v, None) for i, ts, v, _ in points(range(20, 40))]
    land(spark, tmp_path / "in", first, second)
    got = run(sf.rolling_stream(source(spark, tmp_path / "in"), 3), tmp_path)
    batch = sf.rolling(spark.createDataFrame(first + second, POINTS), 3)
    assert got.where("late or seq is not null").count() == 0
    assert rows(got, "identifier", "ts", "rolling_mean") == rows(batch, "identifier", "ts", "rolling_mean")


def disordered(numbers, seed, spread):
    """Points in files, each up to ``spread`` places away from its place in time."""
    import random

    rng = random.Random(seed)
    order = sorted(points(numbers), key=lambda p: p[3] + rng.uniform(0, spread))
    return [order[i : i + 70] for i in range(0, len(order), 70)]


def heartbeat(seconds):
    return [(None, START + timedelta(seconds=seconds), None, None)]


@pytest.mark.parametrize("bucket_s", [1, 45, 3600])
def test_rolling_stream_with_watermark_equals_batch_for_disordered_input(spark, tmp_path, bucket_s):
    value = {5: None, 9: float("nan"), 30: float("inf")}
    files = [[(i, ts, value.get(n, v), n) for i, ts, v, n in f] for f in disordered(range(420), bucket_s, 60)]
    assert any(f != sorted(f, key=lambda p: p[3]) for f in files)
    land(spark, tmp_path / "in", *files, heartbeat(20 * 420 + 20000))
    stream = sf.rolling_stream(source(spark, tmp_path / "in"), 7, 3, ("mean", "median"), watermark="25 minutes", bucket_s=bucket_s)
    got = run(stream, tmp_path)
    batch = spark.createDataFrame([p for f in files for p in f], POINTS)
    assert got.where("late").count() == 0
    assert rows(got.drop("late")) == rows(sf.rolling(batch, 7, 3, ("mean", "median")))


def test_rolling_stream_with_watermark_holds_back_what_may_still_change(spark, tmp_path):
    land(spark, tmp_path / "in", points(range(100)))
    got = run(sf.rolling_stream(source(spark, tmp_path / "in"), 7, watermark="10 minutes", bucket_s=20), tmp_path)
    batch = sf.rolling(spark.createDataFrame(points(range(100)), POINTS), 7)
    until = START + timedelta(seconds=20 * 99 - 600 - 20)
    assert rows(got.drop("late")) == rows(batch.where(F.col("ts") <= F.lit(until)))
    land(spark, tmp_path / "in", points(range(100, 130)), [(0, START, 5.0, 1000)], heartbeat(20 * 130 + 2000))
    got = run(sf.rolling_stream(source(spark, tmp_path / "in"), 7, watermark="10 minutes", bucket_s=20), tmp_path)
    batch = sf.rolling(spark.createDataFrame(points(range(130)), POINTS), 7)
    assert rows(got.where("not late").drop("late")) == rows(batch)
    assert rows(got.where("late"), "seq", "rolling_mean") == [(1000, None)]


def test_one_identifier_with_all_rows_comes_out_bucket_by_bucket(spark, tmp_path):
    data = [(1, START + timedelta(milliseconds=20 * n), float(n % 13), n) for n in range(30_000)]
    land(spark, tmp_path / "in", data[15_000:] + data[:15_000], heartbeat(3600))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        got = run(sf.rolling_stream(source(spark, tmp_path / "in"), 50, 1, ("mean", "median"), watermark="20 minutes", bucket_s=30), tmp_path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert rows(got.drop("late")) == rows(sf.rolling(spark.createDataFrame(data, POINTS), 50, 1, ("mean", "median")))


@pytest.mark.parametrize("every, period", [(60, 60), (60, 200), (120, 60), (40, 400)])
def test_resample_stream_drops_leading_windows_as_batch_does(spark, tmp_path, every, period):
    starts = {0: 0, 1: 100, 2: 333}  # identifiers begin at different times
    data = [p for p in points(range(600)) if p[3] >= starts[p[0]]]
    files = [data[i : i + 150] for i in range(0, len(data), 150)]
    land(spark, tmp_path / "in", *files, heartbeat(20 * 600 + 4000))
    stream = sf.resample_stream(source(spark, tmp_path / "in"), every, period, ("mean", "median"), "1 minute", leading="drop")
    batch = sf.resample(spark.createDataFrame(data, POINTS), every, period, ("mean", "median"))
    got = run(stream, tmp_path)
    assert got.columns == batch.columns and rows(got) == rows(batch)


def test_the_first_pane_is_remembered_across_runs(spark, tmp_path):
    land(spark, tmp_path / "in", points(range(0, 90)))
    run(sf.resample_stream(source(spark, tmp_path / "in"), 60, 600, "mean", "1 minute", leading="drop"), tmp_path)
    land(spark, tmp_path / "in", points(range(90, 300)), heartbeat(20 * 300 + 2000))
    got = run(sf.resample_stream(source(spark, tmp_path / "in"), 60, 600, "mean", "1 minute", leading="drop"), tmp_path)
    assert rows(got) == rows(sf.resample(spark.createDataFrame(points(range(300)), POINTS), 60, 600, "mean"))


def state_rows(spark, tmp_path, stream):
    """Runs the stream, and the states it then holds."""
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return max(p["stateOperators"][-1]["numRowsTotal"] for p in query.recentProgress)


@pytest.mark.parametrize("watermark", [None, "2000 days"])
@pytest.mark.parametrize("id_type", ["bigint", "decimal(20,0)", "string"])
def test_many_identifiers_share_few_states(spark, tmp_path, watermark, id_type):
    big = (1 << 53) + 1  # a float would not hold it
    data = [(big + n % 400, START + timedelta(seconds=7 * n), float(n % 29), n) for n in range(4000)]
    files = [data[a : a + 1500] + [(None, START, 1.0, -1)] for a in range(0, 4000, 1500)]
    land(spark, tmp_path / "in", *files, heartbeat(7 * 4000 + 4000 * 86400))
    named = lambda df: df.withColumn("identifier", F.col("identifier").cast(id_type))
    stream = sf.rolling_stream(named(source(spark, tmp_path / "in")), 6, 2, ("mean", "median"), watermark=watermark, bucket_s=86400, groups=8)
    assert state_rows(spark, tmp_path, stream) <= 8 * (4 if watermark else 1)
    got = spark.read.schema(stream.schema).parquet(f"{tmp_path}/rows")
    assert got.where("late").count() == 0
    assert rows(got.drop("late")) == rows(sf.rolling(named(spark.createDataFrame(data, POINTS)), 6, 2, ("mean", "median")))


def test_first_panes_of_many_identifiers_share_few_states(spark, tmp_path):
    data = [((1 << 53) + 1 + n % 300, START + timedelta(seconds=7 * n), float(n % 29), n) for n in range(3000)]
    land(spark, tmp_path / "in", *[data[a : a + 1000] + [(None, START, 1.0, -1)] for a in range(0, 3000, 1000)], heartbeat(7 * 3000 + 90_000))
    stream = sf.resample_stream(source(spark, tmp_path / "in"), 600, 3000, ("mean", "median"), "1 minute", leading="drop", groups=8)
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/rows").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    panes = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"] if o["operatorName"].startswith("transformWithState")]
    assert 0 < max(panes) <= 8
    got = spark.read.schema(stream.schema).parquet(f"{tmp_path}/rows")
    assert rows(got) == rows(sf.resample(spark.createDataFrame(data, POINTS), 600, 3000, ("mean", "median")))


def test_idle_identifiers_are_forgotten_one_by_one():
    import pandas as pd

    from sensorframe.streaming.rolling import _Answered

    def frame(*rows):
        return pd.DataFrame([(i, us, us, float(us), False) for i, us in rows], columns=["id", "us", "seq", "v", "missing"])

    def rolled(state, rows, now):
        return {(r.id, r.us): r.rolling_mean for r in state.roll(rows, 3, 1, ("mean",), now).itertuples()}

    state = _Answered(None)
    assert rolled(state, frame((7, 1), (8, 1), (7, 2)), 10) == {(7, 1): 1.0, (7, 2): 1.5, (8, 1): 1.0}
    state = _Answered(state.pack())
    assert rolled(state, frame((8, 3)), 20) == {(8, 3): 2.0}
    state.came(frame((7, 1)), 15)  # late
    state.forget(12)
    assert list(state.ids) == [7, 8] and list(state.late(frame((7, 2), (8, 2), (9, 0)))) == [True, True, False]
    state.forget(15)
    state = _Answered(state.pack())
    assert rolled(state, frame((7, 5), (8, 5)), 30) == {(7, 5): 5.0, (8, 5): 3.0}
