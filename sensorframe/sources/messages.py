"""Topic-tagged messages with Arrow payloads: registry, routing, decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

TOPIC_ROOT = "sensors"

#: Decoded rows that are put together.
STEP_ROWS = 10_000

MESSAGES = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("message_id", T.LongType()),
        T.StructField("arrived", T.TimestampNTZType()),
        T.StructField("payload", T.BinaryType()),
    ]
)

# Kind, topic below the root, label, measured quantity, unit, handled on ingest.
SENSORS = [
    ("atuc", "atuc", "ATUC", "Analog turbidity controller", "", True),
    ("ddoc_c1", "ddoc/c1", "C1", "Concentration channel 1", "mA", False),
    ("ddoc_c2", "ddoc/c2", "C2", "Concentration channel 2", "mA", False),
    ("ddoc_t1", "ddoc/t1", "T1", "Temperature channel 1", "°C", False),
    ("ddoc_t2", "ddoc/t2", "T2", "Temperature channel 2", "°C", False),
    ("ddoc_v1", "ddoc/v1", "V1", "Voltage channel 1", "mg/L", False),
    ("ddoc_v2", "ddoc/v2", "V2", "Voltage channel 2", "%", False),
    ("dtec", "dtec", "DTEC", "Digital temperature controller", "", True),
]


def sensors(spark: SparkSession, root: str = TOPIC_ROOT) -> DataFrame:
    """Registry ``(kind, topic, label, description, unit, handled)`` as an inline table, which
    Catalyst sizes and broadcasts by itself."""
    rows = ", ".join(
        f"('{kind}', '{root}/{topic}', '{label}', '{text}', '{unit}', {str(handled).lower()})"
        for kind, topic, label, text, unit, handled in SENSORS
    )
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(kind, topic, label, description, unit, handled)")


def topic_filter(df: DataFrame, prefix: str = TOPIC_ROOT) -> DataFrame:
    """Messages of a topic tree: the topic itself and everything below it."""
    topic = F.col("topic")
    return df.where((topic == prefix) | topic.startswith(f"{prefix}/"))


def message_stream(
    spark: SparkSession, directory: str, prefix: str = TOPIC_ROOT, files_per_trigger: int = 1000
) -> DataFrame:
    """Stream of the messages landing as Parquet in ``directory``.

    ``files_per_trigger`` bounds what one micro-batch takes on after a stop. Where the folder has one subfolder per
    topic, as ``land_messages`` writes, files of other topics than those below ``prefix`` are not read.
    """
    reader = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files_per_trigger)
    return topic_filter(reader.parquet(directory), prefix).select(*MESSAGES.names)


def land_messages(messages: DataFrame, directory: str) -> None:
    """Append messages to a landing folder, one subfolder per topic."""
    messages.select(*MESSAGES.names).write.mode("append").partitionBy("topic").parquet(directory)


def route_topics(messages: DataFrame, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Split messages by exact topic: ``(routed with kind, dead letters)``.

    Only topics marked ``handled`` are routed.
    """
    registry = sensors(messages.sparkSession) if registry is None else registry
    known = registry.where("handled") if "handled" in registry.columns else registry
    routed = messages.join(known.select("topic", "kind"), "topic").select(*messages.columns, "kind")
    dead = messages.join(known.select("topic"), "topic", "left_anti").select(*messages.columns)
    return routed, dead


def decoded_schema(identifier_type: str = "decimal(20,0)") -> T.StructType:
    return T.StructType.fromDDL(
        f"topic string, message_id bigint, arrived timestamp_ntz, row bigint, identifier {identifier_type}, "
        "ts timestamp_ntz, value double, error string"
    )


def decode_payloads(
    messages: DataFrame, identifier_type: str = "decimal(20,0)", *, keep_payload: bool = False
) -> DataFrame:
    """Rows of the first record batch of every payload (an Arrow IPC stream).

    Later batches of the same stream are not read; nanoseconds are cut to
    microseconds. A payload that cannot be decoded gives one row with ``error`` set and never fails the job. Works on
    batch and streaming frames; beside the messages Spark hands over at a time, rows of up to ``STEP_ROWS`` or of one longer
    message are in memory. Neighbouring messages of one shape are cast together.
    """
    id_arrow = pa.int64() if identifier_type == "bigint" else pa.decimal128(20, 0)
    out = pa.schema(
        [
            ("topic", pa.string()),
            ("message_id", pa.int64()),
            ("arrived", pa.timestamp("us")),
            ("row", pa.int64()),
            ("identifier", id_arrow),
            ("ts", pa.timestamp("us")),
            ("value", pa.float64()),
            ("error", pa.string()),
            *([("payload", pa.binary())] if keep_payload else []),
        ]
    )

    def rows_of(topic: pa.Scalar, message_id: pa.Scalar, arrived: pa.Scalar, payload: bytes | None):
        try:
            if payload is None:
                raise ValueError("no payload")
            with pa.ipc.open_stream(payload) as stream:
                batch = stream.read_next_batch()
            count = batch.num_rows
            times = batch.column("Timestamp")
            if times.type == pa.timestamp("ns"):
                times = pc.floor_temporal(times, unit="microsecond")
            columns = [
                pc.cast(batch.column("Identifier"), id_arrow),
                pc.cast(times, pa.timestamp("us")),
                pc.cast(batch.column(batch.num_columns - 1), pa.float64()),
            ]
            error = None
        except StopIteration:
            count, columns, error = 1, None, "no record batch in the stream"
        except Exception as reason:  # whatever a broken payload raises belongs into its row
            count, columns, error = 1, None, f"{type(reason).__name__}: {reason}"
        if columns is None:
            columns = [pa.nulls(1, out.field(name).type) for name in ("identifier", "ts", "value")]
            row = pa.nulls(1, pa.int64())
        else:
            row = pa.array(range(count), pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                *[pa.repeat(scalar, count) for scalar in (topic, message_id, arrived)],
                row,
                *columns,
                pa.repeat(pa.scalar(error, pa.string()), count),
                *([pa.repeat(pa.scalar(payload if error else None, pa.binary()), count)] if keep_payload else []),
            ],
            schema=out,
        )

    def columns_of(payload: pa.Scalar) -> list[pa.Array] | None:
        """Identifier, time and value of a payload's first batch as they are; none if anything is wrong with it."""
        try:
            with pa.ipc.open_stream(payload.as_buffer()) as stream:
                batch = stream.read_next_batch()
            return [batch.column("Identifier"), batch.column("Timestamp"), batch.column(batch.num_columns - 1)]
        except Exception:  # rows_of says what it was
            return None

    def rows_together(batch: pa.RecordBatch, at: list[int], run: list[list[pa.Array]]) -> pa.RecordBatch:
        counts = [len(columns[0]) for columns in run]
        identifier, times, value = (pa.concat_arrays(column) for column in zip(*run))
        if times.type == pa.timestamp("ns"):
            times = pc.floor_temporal(times, unit="microsecond")
        of = pa.array(np.repeat(at, counts))
        total = sum(counts)
        first = np.repeat(np.cumsum([0, *counts[:-1]]), counts)
        return pa.RecordBatch.from_arrays(
            [
                *[pc.cast(batch.column(name), out.field(name).type).take(of) for name in ("topic", "message_id", "arrived")],
                pa.array(np.arange(total) - first, pa.int64()),
                pc.cast(identifier, id_arrow),
                pc.cast(times, pa.timestamp("us")),
                pc.cast(value, pa.float64()),
                pa.nulls(total, pa.string()),
                *([pa.nulls(total, pa.binary())] if keep_payload else []),
            ],
            schema=out,
        )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(name) for name in ("topic", "message_id", "arrived", "payload")]
            done: list[pa.RecordBatch] = []
            at: list[int] = []
            run: list[list[pa.Array]] = []
            held = 0

            def settle() -> None:
                if run:
                    try:
                        done.append(rows_together(batch, at, run))
                    except Exception:  # one of them cannot be cast: each by itself
                        done.extend(rows_of(*(c[i] for c in columns[:3]), columns[3][i].as_py()) for i in at)
                    at.clear()
                    run.clear()

            for i in range(len(batch)):
                found = columns_of(columns[3][i])
                if found is None or run and [c.type for c in found] != [c.type for c in run[0]]:
                    settle()
                if found is None:
                    done.append(rows_of(*(c[i] for c in columns[:3]), columns[3][i].as_py()))
                    held += 1
                else:
                    at.append(i)
                    run.append(found)
                    held += len(found[0])
                if held >= STEP_ROWS:
                    settle()
                    yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                    done.clear()
                    held = 0
            settle()
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    return messages.select("topic", "message_id", "arrived", "payload").mapInArrow(
        decode, decoded_schema(identifier_type).add("payload", "binary") if keep_payload else decoded_schema(identifier_type)
    )


def encode_payloads(
    rows: DataFrame, *, id_col="identifier", ts_col="ts", value_col="value", value_name="Value"
) -> DataFrame:
    """Write rows ``(topic, message_id, identifier, ts, value, arrived)`` as messages, one per
    ``(topic, message_id)``: the inverse of ``decode_payloads``. A message is built in one task,
    so give long batches several ids."""

    def encode(table: pa.Table) -> pa.Table:
        content = pa.table(
            {
                "Identifier": table[id_col],
                "Timestamp": table[ts_col],
                value_name: table[value_col],
            }
        ).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, content.schema) as writer:
            writer.write_batch(content.to_batches()[0])
        return pa.table(
            {
                "topic": table["topic"].slice(0, 1),
                "message_id": table["message_id"].slice(0, 1),
                "arrived": pa.array([pc.max(table["arrived"]).as_py()], pa.timestamp("us")),
                "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
            }
        )

    chosen = rows.select("topic", "message_id", "arrived", id_col, ts_col, value_col)
    return chosen.groupBy("topic", "message_id").applyInArrow(encode, MESSAGES)


def latest_batch_per_topic(messages: DataFrame) -> DataFrame:
    """The last message of each topic: latest arrival, then highest id; once, however often it was delivered.

    On decoded rows (``topic, message_id, arrived, row, …``) it keeps all rows of that message. The rank filter lets
    Spark keep one candidate per topic and task before the shuffle, so a busy topic does not travel.
    """
    newest = Window.partitionBy("topic").orderBy(F.desc("arrived"), F.desc("message_id"))
    decoded = "row" in messages.columns
    ranked = messages.withColumn("__sf_rank", (F.rank() if decoded else F.row_number()).over(newest))
    latest = ranked.where(F.col("__sf_rank") == 1).drop("__sf_rank")
    return latest.dropDuplicates(["topic", "message_id", "row"]) if decoded else latest
