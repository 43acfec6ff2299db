from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows

import sensorframe as sf

T0 = datetime(2024, 1, 1)


@pytest.fixture
def folder(tmp_path):
    def write(name, identifiers, value, unit="ms"):
        table = pa.table(
            {
                "Identifier": pa.array(identifiers, pa.uint64()),
                "Timestamp": pa.array([T0] * len(identifiers), pa.timestamp(unit)),
                **value,
            }
        )
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        pq.write_table(table, path)
        return str(path)

    return write


def test_reads_both_known_log_shapes(spark, folder):
    warm = folder("warm.parquet", [2**63 + 5, 7], {"Temperature": pa.array([20.5, None], pa.float32())})
    murky = folder("murky.parquet", [2**64 - 1], {"Note": pa.array(["x"]), "Turbidity": pa.array([65535], pa.uint16())})
    got = sf.read_logs(spark, [warm, murky])
    assert got.schema["identifier"].dataType.simpleString() == "decimal(20,0)"
    assert rows(got, "file", "metric", "value", "seq", "width") == [
        ("murky.parquet", "turbidity", 65535.0, 0, 4),
        ("warm.parquet", "temperature", 20.5, 0, 3),
        ("warm.parquet", "temperature", None, 1, 3),
    ]
    hexes = got.select(sf.hex_id("identifier", got.schema["identifier"].dataType))
    assert rows(hexes) == [("7",), ("8000000000000005",), ("ffffffffffffffff",)]
    assert {r["ts"] for r in got.collect()} == {T0}
    assert dict(rows(sf.classify(got).select("metric", "kind").distinct())) == {
        "temperature": "temperature",
        "turbidity": "turbidity",
    }


def test_other_metrics_are_read_too(spark, folder):
    path = folder("p.parquet", [1], {"Pressure": pa.array([3], pa.int64())}, unit="us")
    got = sf.classify(sf.read_logs(spark, path))
    assert rows(got, "metric", "kind", "value") == [("pressure", "unknown", 3.0)]


def test_same_schema_shares_one_scan_and_a_repeated_path_is_read_once(spark, folder):
    paths = [folder(f"{n}.parquet", [n], {"Temperature": pa.array([float(n)])}) for n in range(5)]
    got = sf.read_logs(spark, paths + paths[:2])
    assert got.count() == 5
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_unreadable_logs(spark, folder, tmp_path):
    good = folder("good.parquet", [1], {"Temperature": pa.array([1.0])})
    broken = tmp_path / "broken.parquet"
    broken.write_bytes(b"not parquet at all")
    other = tmp_path / "other.parquet"
    pq.write_table(pa.table({"a": [1]}), other)
    paths = [good, str(broken), str(tmp_path / "missing.parquet"), str(other)]
    assert sf.read_logs(spark, paths, on_error="skip").count() == 1
    for path in paths[1:]:
        with pytest.raises(Exception):
            sf.read_logs(spark, [good, path])
    with pytest.raises(ValueError):
        sf.read_logs(spark, paths[1:], on_error="skip")
    with pytest.raises(ValueError):
        sf.read_logs(spark, good, on_error="hide")


def test_a_zoned_timestamp_is_read_as_utc(spark, tmp_path, zone):
    zone("America/New_York")
    path = str(tmp_path / "z.parquet")
    pq.write_table(
        pa.table(
            {
                "Identifier": pa.array([1]),
                "Timestamp": pa.array([T0], pa.timestamp("us", tz="UTC")),
                "Temperature": pa.array([1.0]),
            }
        ),
        path,
    )
    assert rows(sf.read_logs(spark, path), "ts") == [(T0,)]


def test_to_readings_checks_its_columns(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "Identifier bigint, Timestamp string, Value double")
    with pytest.raises(ValueError):
        sf.to_readings(df)
    with pytest.raises(ValueError):
        sf.to_readings(df.drop("Identifier"))
    named = spark.createDataFrame([("x", T0, 2.0)], "Identifier string, Timestamp timestamp_ntz, Value double")
    with pytest.raises(ValueError):
        sf.to_readings(named)


def test_a_folder_of_mixed_logs_is_told_apart(spark, folder, tmp_path):
    folder("mixed/warm.parquet", [1], {"Temperature": pa.array([20.5], pa.float32())})
    folder("mixed/murky.parquet", [1], {"Turbidity": pa.array([700], pa.uint16())})
    folder("mixed/murky2.parquet", [2], {"Turbidity": pa.array([800], pa.uint16())})
    got = sf.read_logs(spark, str(tmp_path / "mixed"))
    assert rows(got, "file", "metric", "value") == [
        ("murky.parquet", "turbidity", 700.0),
        ("murky2.parquet", "turbidity", 800.0),
        ("warm.parquet", "temperature", 20.5),
    ]
    with pytest.raises(ValueError):
        sf.read_raw_logs(spark, str(tmp_path / "mixed"))
    (tmp_path / "mixed" / "bad.parquet").write_bytes(b"nothing")
    assert sf.read_logs(spark, str(tmp_path / "mixed"), on_error="skip").count() == 3


def test_a_file_reached_twice_is_read_once(spark, folder, tmp_path):
    paths = [folder(f"logs/{n}.parquet", [n], {"Temperature": pa.array([float(n)])}) for n in range(3)]
    for again in ([str(tmp_path / "logs"), paths[0]], [paths[0], f"{tmp_path}/logs/./0.parquet"], [f"{tmp_path}/logs/*.parquet", str(tmp_path / "logs")]):
        wanted = 1 if len(again) == 2 and again[0] == paths[0] else 3
        assert sf.read_logs(spark, again).count() == wanted


def test_raw_logs_keep_columns_types_and_names(spark, folder):
    path = folder("r.parquet", [2**64 - 1, 5], {"Comment": pa.array(["x", None]), "Turbidity": pa.array([7, 8], pa.uint16())})
    raw = sf.read_raw_logs(spark, path)
    assert raw.drop("_path", "_file", "_seq").dtypes == [
        ("Identifier", "decimal(20,0)"), ("Timestamp", "timestamp_ntz"), ("Comment", "string"), ("Turbidity", "int"),
    ]
    assert rows(raw, "_file", "_seq", "Comment", "Turbidity") == [("r.parquet", 0, "x", 7), ("r.parquet", 1, None, 8)]
    view = sf.table_view(raw, by="Timestamp", id_col="Identifier", seq_col="_seq")
    assert rows(sf.export_view(view.drop("_path")), "Identifier", "Turbidity") == [("5", 8), ("f" * 16, 7)]


def test_a_damaged_file_is_skipped_as_a_whole(spark, folder, tmp_path):
    good = folder("d/good.parquet", [1], {"Temperature": pa.array([1.0])})
    bad = tmp_path / "d" / "bad.parquet"
    table = pa.table({"Identifier": pa.array(range(20_000), pa.uint64()), "Timestamp": pa.array([T0] * 20_000, pa.timestamp("ms")), "Temperature": pa.array([n * 1.1 for n in range(20_000)])})
    pq.write_table(table, bad, row_group_size=5000, compression="zstd", use_dictionary=False)
    content = bytearray(bad.read_bytes())
    third = pq.ParquetFile(bad).metadata.row_group(2).column(2)
    for i in range(third.data_page_offset + 40, third.data_page_offset + third.total_compressed_size - 8):
        content[i] ^= 0x5A
    bad.write_bytes(content)
    got = sf.read_logs(spark, str(tmp_path / "d"), on_error="skip")
    assert rows(got, "file", "value") == [("good.parquet", 1.0)]
    with pytest.raises(Exception):
        sf.read_logs(spark, [good, str(bad)]).agg({"value": "sum"}).collect()
