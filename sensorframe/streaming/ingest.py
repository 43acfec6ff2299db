"""Continuous ingest of messages into Parquet."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.messages import decode_payloads, latest_batch_per_topic, route_topics


UNHANDLED = "no handler for this topic"


def _trigger(writer, available_now: bool):
    return writer.trigger(availableNow=True) if available_now else writer


def _replace_partitions(df: DataFrame, path: str, *columns: str) -> None:
    # Only the partitions present in df are replaced, so a repeated micro-batch
    # overwrites its own output.
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*columns)
        .parquet(path)
    )


def ingest_stream(
    messages: DataFrame,
    out_dir: str,
    checkpoint: str,
    registry: DataFrame | None = None,
    *,
    identifier_type: str = "decimal(20,0)",
    available_now: bool = False,
) -> StreamingQuery:
    """Route, decode and store a message stream.

    ``out_dir/readings`` (partitioned by micro-batch and topic) holds the
    decoded rows, undecodable payloads included as ``error`` rows;
    ``out_dir/dead_letters`` holds messages of unhandled topics. Writing is
    exactly-once: a micro-batch run again replaces its own partitions.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        # two outputs from one read of the micro-batch
        batch.persist(StorageLevel.DISK_ONLY)
        try:
            routed, dead = route_topics(batch, registry)
            number = F.lit(batch_id).cast("bigint").alias("batch")
            rows = decode_payloads(routed, identifier_type)
            _replace_partitions(rows.select("*", number), f"{out_dir}/readings", "batch", "topic")
            _replace_partitions(dead.select("*", number), f"{out_dir}/dead_letters", "batch")
        finally:
            batch.unpersist()

    writer = messages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now).start()


def latest_stream(
    messages: DataFrame,
    out_dir: str,
    checkpoint: str,
    registry: DataFrame | None = None,
    *,
    identifier_type: str = "decimal(20,0)",
    available_now: bool = False,
) -> StreamingQuery:
    """Keep the newest decodable batch of each handled topic under ``out_dir/rows/topic=…``.

    Newest by arrival, then id, over all micro-batches: a message that lands late never replaces a newer one, and
    messages older than what is stored are not decoded. Undecodable payloads and messages of unhandled topics go to
    ``out_dir/dead_letters`` (by micro-batch, with ``error``) and leave the stored batch as it is.
    """

    def newest_stored(spark: SparkSession) -> DataFrame:
        schema = "topic string, at timestamp_ntz, id bigint"
        try:
            stored = spark.read.parquet(f"{out_dir}/rows")
        except AnalysisException:  # nothing stored yet
            return spark.createDataFrame([], schema)
        # one row for each handled topic of the registry
        keys = stored.groupBy("topic").agg(F.max(F.struct("arrived", "message_id")).alias("k"))
        return spark.createDataFrame(keys.select("topic", "k.arrived", "k.message_id").collect(), schema)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.DISK_ONLY)
        try:
            routed, dead = route_topics(batch, registry)
            known = newest_stored(batch.sparkSession)
            fresh = routed.join(known, "topic", "left").where(
                F.col("id").isNull() | (F.struct("arrived", "message_id") >= F.struct(F.col("at"), F.col("id")))
            )
            rows = decode_payloads(fresh, identifier_type)
            good = rows.where(F.col("error").isNull()).drop("error")
            _replace_partitions(latest_batch_per_topic(good), f"{out_dir}/rows", "topic")
            letters = dead.withColumn("error", F.lit(UNHANDLED)).unionByName(
                rows.where(F.col("error").isNotNull())
                .select("topic", "message_id", "arrived", "error")
                .join(routed.select("topic", "message_id", "arrived", "payload"), ["topic", "message_id", "arrived"], "left")
            )
            letters = letters.withColumn("batch", F.lit(batch_id).cast("bigint"))
            _replace_partitions(letters, f"{out_dir}/dead_letters", "batch")
        finally:
            batch.unpersist()

    writer = messages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now).start()


def append_readings_stream(
    messages: DataFrame,
    out_dir: str,
    checkpoint: str,
    registry: DataFrame | None = None,
    *,
    identifier_type: str = "decimal(20,0)",
    available_now: bool = False,
) -> StreamingQuery:
    """Append every decoded row to its topic's folder: the log grows, nothing is replaced and nothing is lost.

    One exactly-once file sink with two branches: ``outcome=reading`` holds decoded rows, ``outcome=dead_letter`` one
    row for each message that could not be decoded or has no handler, with ``error`` and the ``payload``.
    """
    routed, dead = route_topics(messages, registry)
    rows = decode_payloads(routed, identifier_type, keep_payload=True)
    letters = dead.select(
        *[(F.col(c) if c in dead.columns else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in rows.columns if c != "error"],
        F.lit(UNHANDLED).alias("error"),
    )
    outcome = F.when(F.col("error").isNull(), F.lit("reading")).otherwise(F.lit("dead_letter")).alias("outcome")
    writer = (
        rows.unionByName(letters)
        .select("*", outcome)
        .writeStream.format("parquet")
        .partitionBy("outcome", "topic")
        .outputMode("append")
        .option("path", out_dir)
        .option("checkpointLocation", checkpoint)
    )
    return _trigger(writer, available_now).start()
