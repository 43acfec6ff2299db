from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from conftest import rows

import sensorframe as sf
from sensorframe.sources.messages import MESSAGES

T0 = datetime(2024, 1, 1)


def payload(*batches, value=("Temperature", pa.float32()), unit="ms"):
    schema = pa.schema([("Identifier", pa.uint64()), ("Timestamp", pa.timestamp(unit)), value])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        for batch in batches:
            columns = [pa.array(column, field.type) for column, field in zip(zip(*batch), schema)]
            columns = columns or [pa.array([], field.type) for field in schema]
            writer.write_batch(pa.record_batch(columns, schema=schema))
    return sink.getvalue().to_pybytes()


GOOD = payload([(2**64 - 1, T0, 1.5), (7, None, None)])
TWO = payload([(1, T0, 1.0)], [(2, T0, 2.0)])
SMALL = payload([(3, T0, 65535)], value=("Turbidity", pa.uint16()), unit="ns")


@pytest.fixture(scope="module")
def inbox(spark):
    contents = [
        ("sensors/dtec", 1, 0, GOOD),
        ("sensors/atuc", 2, 1, SMALL),
        ("sensors/dtec", 3, 2, TWO),
        ("sensors/ddoc/c1", 4, 3, GOOD),
        ("sensors/atuc", 5, 4, b"\x00broken"),
        ("sensors/atuc", 6, 5, None),
        ("sensors/dtec", 7, 6, payload()),
        ("elsewhere/dtec", 8, 7, GOOD),
        ("sensorsdtec", 9, 8, GOOD),
    ]
    data = [(t, m, T0 + timedelta(minutes=n), p) for t, m, n, p in contents]
    return spark.createDataFrame(data, MESSAGES)


def test_registry(spark):
    registry = sf.sensors(spark).collect()
    assert len(registry) == 8
    assert {r["topic"] for r in registry if r["handled"]} == {"sensors/atuc", "sensors/dtec"}
    assert sf.sensors(spark, "lab").first()["topic"] == "lab/atuc"


def test_topic_tree(inbox):
    assert rows(sf.topic_filter(inbox), "message_id") == [(n,) for n in range(1, 8)]
    assert rows(sf.topic_filter(inbox, "sensors/ddoc"), "message_id") == [(4,)]
    assert rows(sf.topic_filter(inbox, "sensors/atuc"), "message_id") == [(2,), (5,), (6,)]


def test_routing_is_complete_and_disjoint(inbox):
    routed, dead = sf.route_topics(inbox)
    assert rows(routed, "message_id", "kind") == [
        (1, "dtec"), (2, "atuc"), (3, "dtec"), (5, "atuc"), (6, "atuc"), (7, "dtec"),
    ]
    assert rows(dead, "message_id") == [(4,), (8,), (9,)]
    assert dead.columns == inbox.columns


def test_decode(inbox):
    decoded = sf.decode_payloads(inbox.where("message_id < 8")).collect()
    by_message = {}
    for r in sorted(decoded, key=lambda r: (r["message_id"], r["row"] or 0)):
        by_message.setdefault(r["message_id"], []).append(r)
    good = [(int(r["identifier"]), r["ts"], r["value"], r["error"]) for r in by_message[1]]
    assert good == [(2**64 - 1, T0, 1.5, None), (7, None, None, None)]
    assert [r["row"] for r in by_message[1]] == [0, 1]
    # first batch only
    assert [(int(r["identifier"]), r["value"]) for r in by_message[3]] == [(1, 1.0)]
    assert [(int(r["identifier"]), r["ts"], r["value"]) for r in by_message[2]] == [(3, T0, 65535.0)]
    for broken in (5, 6, 7):
        (row,) = by_message[broken]
        assert row["error"] and row["identifier"] is None and row["row"] is None


def test_decode_to_bigint_reports_what_does_not_fit(inbox):
    decoded = {r["message_id"]: r for r in sf.decode_payloads(inbox, "bigint").collect()}
    assert "ArrowInvalid" in decoded[1]["error"]
    assert decoded[3]["identifier"] == 1


def test_encode_is_the_inverse(spark):
    data = [("t", n // 10, n, T0 + timedelta(seconds=n), n / 4 if n % 3 else None) for n in range(45)]
    df = spark.createDataFrame(data, "topic string, message_id bigint, identifier bigint, ts timestamp_ntz, value double")
    messages = sf.encode_payloads(df.withColumn("arrived", df["ts"]))
    assert messages.count() == 5
    back = sf.decode_payloads(messages, "bigint")
    assert rows(back, "topic", "message_id", "identifier", "ts", "value") == rows(df)


def test_latest_batch_per_topic(inbox):
    assert rows(sf.latest_batch_per_topic(inbox), "topic", "message_id") == [
        ("elsewhere/dtec", 8),
        ("sensors/atuc", 6),
        ("sensors/ddoc/c1", 4),
        ("sensors/dtec", 7),
        ("sensorsdtec", 9),
    ]


def test_latest_batch_ties_go_to_the_higher_id(spark):
    df = spark.createDataFrame([("t", n, T0, b"") for n in (1, 3, 2)], MESSAGES)
    assert rows(sf.latest_batch_per_topic(df), "message_id") == [(3,)]


def test_a_redelivered_message_counts_once(spark, inbox):
    twice = inbox.unionByName(inbox)
    assert rows(sf.latest_batch_per_topic(twice), "topic", "message_id") == rows(sf.latest_batch_per_topic(inbox), "topic", "message_id")
    decoded = sf.latest_batch_per_topic(sf.decode_payloads(twice))
    assert rows(decoded) == rows(sf.latest_batch_per_topic(sf.decode_payloads(inbox)))


def test_nanoseconds_are_cut_to_microseconds(spark):
    for ns, us in ((1_704_067_200_000_000_789, 0), (-1, -1_704_067_200_000_001)):
        log = pa.record_batch({"Identifier": pa.array([1]), "Timestamp": pa.array([ns], pa.timestamp("ns")), "V": pa.array([1.0])})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, log.schema) as writer:
            writer.write_batch(log)
        df = spark.createDataFrame([("t", 1, T0, sink.getvalue().to_pybytes())], MESSAGES)
        (row,) = sf.decode_payloads(df).collect()
        assert row["error"] is None and row["ts"] == datetime(2024, 1, 1) + timedelta(microseconds=us)


class Captured:
    """Takes the place of a DataFrame to run what goes to tasks."""

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        return function


@pytest.mark.parametrize("keep_payload", [False, True])
def test_short_messages_are_decoded_together_and_as_they_would_be_alone(keep_payload):
    negative = payload([(5, T0, -1.0)], value=("Value", pa.float64())).replace(b"Identifier", b"Identifies")  # no such column
    nanos = payload([(6, T0, 1)], value=("Turbidity", pa.uint16()), unit="ns")
    huge = [GOOD, payload([(8, T0, 2.0)]), GOOD]  # does not fit into a bigint, beside one that does
    contents = [payload([(n, T0, n), (n, None, None)]) for n in range(3000)] + [nanos, SMALL, TWO, None, negative, b"", *huge, payload([]), payload([(9, T0, 1.0)])]
    table = pa.table(
        {
            "topic": [f"sensors/{n % 3}" for n in range(len(contents))],
            "message_id": pa.array(range(len(contents)), pa.int64()),
            "arrived": pa.array([T0] * len(contents), pa.timestamp("us")),
            "payload": pa.array(contents, pa.binary()),
        }
    )
    decode = sf.decode_payloads(Captured(), "bigint", keep_payload=keep_payload)
    together = list(decode(iter(table.to_batches())))
    assert len(together) == 1
    alone = [b for n in range(len(contents)) for b in decode(iter(table.slice(n, 1).to_batches()))]
    together = pa.Table.from_batches(together)
    assert together.equals(pa.Table.from_batches(alone, together.schema))
    errors = together.filter(pa.compute.is_valid(together["error"]))["message_id"].to_pylist()
    assert errors == [3003, 3004, 3005, 3006, 3008] and together.num_rows == 6000 + 3 + 5 + 1 + 1
    assert [r["identifier"] for r in together.slice(0, 6000).to_pylist()] == [n // 2 for n in range(6000)]


def test_long_runs_of_messages_come_out_in_steps():
    many = pa.table({"topic": ["t"] * 25_000, "message_id": range(25_000), "arrived": pa.array([T0] * 25_000, pa.timestamp("us")), "payload": [SMALL] * 25_000})
    out = list(sf.decode_payloads(Captured(), "bigint")(iter(many.combine_chunks().to_batches())))
    assert [len(b) for b in out] == [10_000, 10_000, 5_000]
    assert pa.Table.from_batches(out)["message_id"].to_pylist() == list(range(25_000))
