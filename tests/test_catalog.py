import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

import sensorframe as sf

START = datetime(2024, 1, 1)


def log(spark, path, file, metric, points, **kw):
    data = [(i, None if m is None else START + timedelta(minutes=m, milliseconds=900), v) for i, m, v in points]
    df = spark.createDataFrame(data, "Identifier bigint, Timestamp timestamp_ntz, Value double")
    return sf.to_readings(df, path=path, file=file, metric=metric, **kw)


A = [(1, 0, 1.0), (1, 1, 2.0), (2, 2, None), (None, 3, 4.0)]
B = [(1, 10, 7.0), (2, None, 8.0)]


@pytest.fixture(scope="module")
def readings(spark):
    return sf.union_logs(
        log(spark, "d/b", "b", "turbidity", B),
        log(spark, "d/a", "a", "temperature", A),
        log(spark, "e/a", "a", "temperature", list(reversed(A))),
        log(spark, "d/c", "c", "temperature", A),
        log(spark, "d/z", "z", "pressure", [(1, None, 3.0)]),
    )


def test_profile(readings):
    got = {r["path"]: r for r in sf.profile_logs(readings).collect()}
    assert len(got) == 5
    a = got["d/a"]
    assert (a["min_ts"], a["max_ts"]) == ("2024-01-01 00:00:00", "2024-01-01 00:03:00")
    assert (a["rows"], a["columns"], a["null_ts"], a["null_id"]) == (4, 3, 0, 1)
    assert got["d/b"]["null_ts"] == 1
    assert (got["d/z"]["min_ts"], got["d/z"]["max_ts"], got["d/z"]["rows"]) == (None, None, 1)


def test_catalog_order(readings):
    order = sorted(sf.catalog(readings).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in order] == [0, 1, 2, 3, 4]
    assert [r["path"] for r in order] == ["d/z", "d/a", "e/a", "d/c", "d/b"]


def test_merge_profile(readings):
    profiles = sf.catalog(readings)
    merged = sf.merge_profile(profiles, ["a", "b"])
    assert rows(merged) == [("turbidity", "2024-01-01 00:00:00", "2024-01-01 00:10:00", 10)]
    assert sf.merge_profile(profiles).first()["rows"] == 15
    with pytest.raises(ValueError):
        sf.merge_profile(profiles, [])


def test_fingerprint_depends_on_content_only(spark, readings):
    prints = {r["path"]: r["fingerprint"] for r in sf.fingerprint_logs(readings).collect()}
    assert prints["d/a"] == prints["e/a"] == prints["d/c"]  # same rows, whatever their order or name
    assert len(set(prints.values())) == 3
    shuffled = sf.fingerprint_logs(readings.repartition(5, "value"))
    assert {r["path"]: r["fingerprint"] for r in shuffled.collect()} == prints


@pytest.mark.parametrize(
    "left, right",
    [
        ([(1, 0, None)], [(None, 0, 1.0)]),  # a null in another place
        ([(1, 0, 1.0)], [(1, 0, 1.0), (1, 0, 1.0)]),  # one row more
        ([(1, 0, 1.0), (2, 0, 2.0)], [(1, 0, 2.0), (2, 0, 1.0)]),  # values swapped
    ],
)
def test_fingerprint_tells_logs_apart(spark, left, right):
    both = sf.union_logs(log(spark, "l", "x", "m", left), log(spark, "r", "x", "m", right))
    assert len({r["fingerprint"] for r in sf.fingerprint_logs(both).collect()}) == 2


def test_dedup(readings):
    by_name = sf.dedup_logs(readings)
    assert {r["path"] for r in by_name.collect()} == {"d/a", "d/b", "d/c", "d/z"}
    by_content = sf.dedup_logs(readings, by_name=False)
    assert {r["path"] for r in by_content.collect()} == {"d/a", "d/b", "d/z"}
    assert rows(sf.dedup_logs(by_name)) == rows(by_name)
    assert by_name.count() == 4 + 2 + 4 + 1


def test_dedup_keeps_logs_without_path(spark):
    nameless = log(spark, None, None, "m", A)
    assert sf.dedup_logs(nameless).count() == 4


def test_select_and_drop(spark, readings):
    chosen = spark.createDataFrame([("a",), ("c",)], "file string")
    for files in (["a", "c"], chosen):
        kept = sf.select_logs(readings, files)
        assert {r["file"] for r in kept.collect()} == {"a", "c"} and kept.count() == 12
        rest = sf.drop_logs(readings, files)
        assert {r["file"] for r in rest.collect()} == {"b", "z"} and rest.count() == 3
    assert sf.select_logs(readings).count() == 15 and sf.select_logs(readings, []).count() == 0
    assert sf.drop_logs(readings).count() == 0 and sf.drop_logs(readings, []).count() == 15


def test_union_is_strict(spark, readings):
    assert sf.union_logs(readings, readings).count() == 30
    other = readings.withColumn("value", F.col("value").cast("int"))
    with pytest.raises(ValueError):
        sf.union_logs(readings, other)
    with pytest.raises(ValueError):
        sf.union_logs(readings, readings.select(*reversed(readings.columns)))
    loose = sf.union_logs(readings, readings.drop("seq"), strict=False)
    assert loose.count() == 30
    with pytest.raises(ValueError):
        sf.union_logs()


def test_classify(readings):
    got = dict(rows(sf.classify(readings).select("metric", "kind").distinct()))
    assert got == {"temperature": "temperature", "turbidity": "turbidity", "pressure": "unknown"}
    assert sf.classify(readings).count() == 15


def test_nothing_to_merge(spark, readings):
    profiles = sf.catalog(readings)
    for chosen in (["no such log"], profiles.select("file").limit(0)):
        with pytest.raises(ValueError):
            sf.merge_profile(profiles, chosen)


def test_logs_that_differ_in_any_column_are_not_equal(spark):
    raw = spark.createDataFrame(
        [("p1", "a", 1, 2.0, "x"), ("p2", "a", 1, 2.0, "x"), ("p3", "a", 1, 2.0, "y"), ("p4", "a", 1, 2.0, None)],
        "_path string, _file string, Identifier bigint, Value double, Comment string",
    )
    kept = sf.dedup_logs(raw, log_cols=("_path", "_file"), name_col="_file")
    assert rows(kept, "_path") == [("p1",), ("p3",), ("p4",)]
