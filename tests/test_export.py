import csv
from datetime import datetime
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

import sensorframe as sf

SCHEMA = (
    "id bigint, big decimal(20,0), small int, tiny tinyint, real float, value double, "
    "ok boolean, name string, ts timestamp_ntz"
)


@pytest.fixture
def table(spark):
    full = (-1, Decimal(2**64 - 1), 7, 3, 1.5, 2.345678, True, "x,y", datetime(2024, 3, 10, 2, 30, 5, 999000))
    return spark.createDataFrame([full, (None,) * 9], SCHEMA)


def test_cells(table):
    first, second = sf.export_view(table).collect()
    assert tuple(first) == ("f" * 16, "f" * 16, 7, 3, 1.5, 2.345678, True, "x,y", "2024-03-10 02:30:05")
    assert tuple(second) == (None,) * 9
    assert sf.export_view(table).columns == table.columns


def test_precision_and_zone(table):
    row = sf.export_view(table, precision=2, tz="+03:00").first()
    assert (row["value"], row["ts"]) == (2.35, "2024-03-10 05:30:05")


def test_unsupported_types_are_named(spark):
    with pytest.raises(TypeError, match="dates"):
        sf.export_view(spark.sql("select date'2024-01-01' as dates"))


def test_csv(table, spark, tmp_path):
    path = str(tmp_path / "out")
    sf.write_export(table.coalesce(1), path)
    lines = [line for f in (tmp_path / "out").glob("*.csv") for line in f.read_text().splitlines()]
    assert lines[0] == "id,big,small,tiny,real,value,ok,name,ts"
    assert lines[1].startswith("ffffffffffffffff,ffffffffffffffff,7,3,1.5,2.345678,true")
    assert lines[2] == "," * 8


def test_parquet(table, spark, tmp_path):
    path = str(tmp_path / "out")
    sf.write_export(table, path, "parquet")
    assert rows(spark.read.parquet(path)) == rows(sf.export_view(table))
    with pytest.raises(ValueError):
        sf.write_export(table, path, "xml")


def test_csv_is_read_back_by_others(spark, tmp_path):
    texts = ['{"k": 69}', 'say "hi", twice', "two\nlines", "", None, "back\\slash"]
    table = spark.createDataFrame(list(enumerate(texts)), "n int, text string").withColumn("nothing", F.lit(None))
    path = str(tmp_path / "out")
    sf.write_export(table.coalesce(1), path)
    (file,) = (tmp_path / "out").glob("*.csv")
    with open(file, newline="") as lines:
        got = list(csv.reader(lines))
    assert got == [["n", "text", "nothing"], *[[str(n), t or "", ""] for n, t in enumerate(texts)]]
    raw = file.read_text().splitlines()
    assert '3,"",' in raw and "4,," in raw  # an empty text is no null
