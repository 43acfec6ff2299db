import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

import sensorframe as sf
from sensorframe.operators import table as table_module

SCHEMA = "identifier bigint, ts timestamp_ntz, value double, seq bigint"


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(1)
    data = []
    for n in range(500):
        identifier = None if rng.random() < 0.05 else rng.choice([4, 4, 4, 4, 15, 16])
        ts = None if rng.random() < 0.05 else datetime(2024, 1, 1) + timedelta(minutes=rng.randint(0, 50))
        value = rng.choice([None, float("nan"), rng.randint(0, 9) / 2, rng.randint(0, 9) / 2])
        data.append((identifier, ts, value, n))
    return spark.createDataFrame(data, SCHEMA)


def key(value):
    # nulls first, NaN greatest
    if value is None:
        return (0, 0)
    return (1, float("inf")) if value != value else (1, value)


def in_order(df, by, order):
    data = sorted(df.collect(), key=lambda r: r["seq"])
    return [r["seq"] for r in sorted(data, key=lambda r: key(r[by]), reverse=False)] if order == "asc" else [
        r["seq"] for r in sorted(data, key=lambda r: key(r[by]), reverse=True)
    ]


@pytest.mark.parametrize("by", ["identifier", "ts", "value"])
@pytest.mark.parametrize("order", ["asc", "desc"])
def test_sort_index_and_page_agree(spark, log, monkeypatch, by, order):
    wanted = in_order(log, by, order)
    assert [r["seq"] for r in sf.sort_table(log, by, order).collect()] == wanted
    numbered = {r["row_index"]: r["seq"] for r in sf.index_table(log, by, order).collect()}
    assert [numbered[n] for n in range(len(wanted))] == wanted
    shallow = [r["seq"] for r in sf.page(log, 100, 30, by, order).collect()]
    monkeypatch.setattr(table_module, "TOP_K_ROWS", 10)
    deep = [r["seq"] for r in sf.page(log, 100, 30, by, order).collect()]
    assert shallow == deep == wanted[100:130]


def test_page_past_the_end(log):
    assert len(sf.page(log, 495, 30).collect()) == 5
    assert sf.page(log, 900, 30).collect() == []
    with pytest.raises(ValueError):
        sf.page(log, -1, 1)


def test_row_index_spreads_one_dominant_value(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tiny partitions stay apart
    df = spark.range(20000).select(F.lit(1).alias("k"), "id")
    numbered = sf.with_row_index(df.repartition(8), "k", "id")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert numbered.where(F.col("row_index") != F.col("id")).count() == 0
    per_task = numbered.groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in per_task) < 10000


def test_row_index_of_nothing(spark):
    assert sf.with_row_index(spark.range(0), "id").collect() == []


def test_exclude(log):
    everything = rows(log, "seq")
    assert rows(sf.exclude_identifiers(log, []), "seq") == everything
    one = sf.exclude_identifiers(log, [15])
    # excluding anything also drops the rows without identifier
    assert rows(one, "seq") == rows(log.where("identifier <> 15"), "seq")
    by_table = sf.exclude_identifiers(log, log.where("identifier in (15)"))
    assert rows(by_table) == rows(one)
    assert rows(sf.exclude_identifiers(log, log.where("false")), "seq") == everything
    assert sf.exclude_identifiers(log, "all").count() == 0
    unnamed = log.where("identifier is null")
    assert rows(sf.exclude_identifiers(unnamed, "all")) == rows(unnamed)
    with pytest.raises(ValueError):
        sf.exclude_identifiers(log, "some")


def test_distinct_identifiers(log):
    assert rows(sf.distinct_identifiers(log)) == [(15,), (16,), (4,)]


def test_table_view_is_a_permutation_of_the_kept_rows(log):
    view = sf.table_view(log, exclude=[4], by="value", order="desc")
    assert rows(view) == rows(log.where("identifier <> 4"))
    assert [r["seq"] for r in view.collect()] == in_order(log.where("identifier <> 4"), "value", "desc")


def test_bad_order(log):
    with pytest.raises(ValueError):
        sf.sort_table(log, "ts", "up")
    with pytest.raises(ValueError):
        sf.sort_table(log, "nothing")


@pytest.mark.parametrize("limit", [3, 1000])
def test_points(spark, log, limit):
    series = sf.source_series(log)
    points = sf.to_points(series, limit).collect()
    assert max(len(r["points"]) for r in points) <= limit
    for identifier in (4, 15, 16):
        chunks = sorted((r["chunk"], r["points"]) for r in points if r["identifier"] == identifier)
        assert [c for c, _ in chunks] == list(range(len(chunks)))
        got = [p["x"] for _, ps in chunks for p in ps]
        wanted = [r["x"] for r in series.where(F.col("identifier") == identifier).orderBy("x", "seq").collect()]
        assert got == wanted
