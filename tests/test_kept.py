"""Tables, catalogs and landing folders that are kept so that less is read."""

import glob
import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

import sensorframe as sf
from test_messages import GOOD

START = datetime(2024, 1, 1)
SCHEMA = "identifier bigint, ts timestamp_ntz, value double, seq bigint"


def table(spark, n=500):
    rng = random.Random(n)
    data = [(rng.randint(1, 9), START + timedelta(seconds=rng.randint(0, 99)), rng.choice([None, float(rng.randint(0, 30))]), i) for i in range(n)]
    return spark.createDataFrame(data, SCHEMA).repartition(5)


@pytest.mark.parametrize("by, order", [("ts", "asc"), ("value", "desc"), ("value", "asc")])
def test_pages_of_a_kept_table_equal_the_sorted_table(spark, by, order):
    df = table(spark)
    kept = sf.keep_order(df, by, order)
    whole = [tuple(r) for r in sf.sort_table(df, by, order).collect()]
    assert kept.count() == 500
    for offset, limit in [(0, 10), (0, 500), (123, 200), (490, 50), (500, 5), (0, 0), (250, 1)]:
        assert [tuple(r) for r in kept.page(offset, limit).collect()] == whole[offset : offset + limit]
    again = sf.open_order(spark, kept.path).page(77, 3, name="position")
    assert [tuple(r) for r in again.collect()] == [(*whole[i], i) for i in (77, 78, 79)]


def test_a_page_reads_only_its_files_and_does_not_sort_the_table(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = sf.keep_order(table(spark, 3000), "seq")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = kept.ranges.count()
    assert parts == 8 and len(glob.glob(f"{kept.path}/rows/*/*.parquet")) == parts
    for offset, files in ((10, 1), (2900, 1), (0, None)):
        page = kept.page(offset, 20 if files else 3000)
        assert len(page.inputFiles()) == (files or parts)
        assert [r.seq for r in page.select("seq").collect()] == list(range(offset, min(3000, offset + (20 if files else 3000))))


def test_odd_pages_and_tables(spark):
    kept = sf.keep_order(table(spark).limit(0))
    assert kept.count() == 0 and kept.page(0, 5).collect() == []
    for bad in ((-1, 5), (0, -5)):
        with pytest.raises(ValueError):
            kept.page(*bad)
    with pytest.raises(ValueError):
        sf.keep_order(table(spark), "nothing")


LOG = "Identifier bigint, Timestamp timestamp_ntz, Temperature float"


def write_log(spark, path, seed, n=20):
    spark.createDataFrame([(seed, START + timedelta(seconds=i), float(i + seed)) for i in range(n)], LOG).coalesce(1).write.parquet(str(path))


def test_a_second_insert_reads_only_new_logs(spark, tmp_path, monkeypatch):
    for seed in range(3):
        write_log(spark, tmp_path / "logs" / f"l{seed}", seed)
    catalog = sf.KeptCatalog(spark, str(tmp_path / "catalog"))
    assert catalog.insert(str(tmp_path / "logs")) == 3
    write_log(spark, tmp_path / "logs" / "l3", 3)
    write_log(spark, tmp_path / "logs" / "copy", 1)
    read = []
    from sensorframe.sources import kept_catalog

    monkeypatch.setattr(kept_catalog, "read_logs", lambda s, paths, on_error: read.extend(paths) or sf.read_logs(s, paths, on_error))
    assert catalog.insert(str(tmp_path / "logs")) == 2 == len(read)
    assert all("/l3/" in p or "/copy/" in p for p in read)
    assert catalog.insert([str(tmp_path / "logs")]) == 0 and len(read) == 2
    everything = sf.read_logs(spark, [str(p) for p in (tmp_path / "logs").iterdir()])
    monkeypatch.undo()
    for by_name in (True, False):
        assert rows(catalog.readings(by_name)) == rows(sf.dedup_logs(everything, by_name))
    columns = ["path", "min_ts", "max_ts", "rows", "columns", "null_ts", "null_id"]
    assert rows(catalog.entries(), *columns) == rows(sf.profile_logs(everything), *columns)
    prints = sf.fingerprint_logs(everything)
    assert rows(catalog.entries(), "path", "fingerprint") == rows(prints, "path", "fingerprint")


def test_a_changed_log_takes_the_place_of_the_old_one(spark, tmp_path):
    write_log(spark, tmp_path / "logs" / "a", 1)
    catalog = sf.KeptCatalog(spark, str(tmp_path / "catalog"))
    catalog.insert(str(tmp_path / "logs"))
    (file,) = glob.glob(str(tmp_path / "logs" / "a" / "*.parquet"))
    write_log(spark, tmp_path / "other", 1, 33)
    (other,) = glob.glob(str(tmp_path / "other" / "*.parquet"))
    with open(other, "rb") as source, open(file, "wb") as target:
        target.write(source.read())
    for checksum in glob.glob(str(tmp_path / "logs" / "a" / ".*.crc")):
        import os

        os.remove(checksum)
    assert catalog.insert(str(tmp_path / "logs")) == 1
    assert rows(catalog.entries(), "rows") == [(33,)]


def test_a_catalog_of_nothing(spark, tmp_path):
    catalog = sf.KeptCatalog(spark, str(tmp_path / "catalog"))
    assert catalog.entries().count() == 0 and catalog.distinct_logs().count() == 0


def test_a_stream_of_one_topic_reads_no_other(spark, tmp_path):
    schema = "topic string, message_id bigint, arrived timestamp_ntz, payload binary"
    sent = [(t, i, START, GOOD) for i, t in enumerate(["sensors/dtec", "sensors/atuc", "sensors/dtec/x", "elsewhere"])]
    sf.land_messages(spark.createDataFrame(sent, schema), str(tmp_path / "in"))
    for other in ("sensors%2Fatuc", "elsewhere"):
        for file in glob.glob(str(tmp_path / "in" / f"topic={other}" / "*.parquet")):
            with open(file, "wb") as target:
                target.write(b"not to be read")
    stream = sf.message_stream(spark, str(tmp_path / "in"), "sensors/dtec")
    assert stream.columns == ["topic", "message_id", "arrived", "payload"]
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "topic", "message_id") == [("sensors/dtec", 0), ("sensors/dtec/x", 2)]
