"""

All queries read the whole ``events`` table as sensor readings: every event
type is one log, ``user_id`` (or ``user_id % 10``, ten dense sensors that share
all rows, for time windows) is the identifier, ``event_id`` breaks ties.
"""

from __future__ import annotations

import functools
import os
import sys
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import sensorframe as sf  # noqa: E402
from sensorframe.scratch import scratch_path  # noqa: E402
from sensorframe.sources.messages import SENSORS  # noqa: E402

try:
    import corpus_pipeline
    from sensorframe.llm import queries as llm
except ModuleNotFoundError as error:  # the subpackage may be left out, but not broken
    if error.name not in ("corpus_pipeline", "sensorframe.llm", "public_tokenizers"):
        raise
    corpus_pipeline = llm = None

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
KNOWN = ["click", "purchase", "view"]
HOUR = 3600
DAY = 86400


# --- scratch ----------------------------------------------------------------


def with_scratch(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """On a single machine without a checkpoint folder, name a temporary one first."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        context = spark.sparkContext
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not named and context.master.startswith("local[") or not named and context.master == "local":
            context.setCheckpointDir(tempfile.mkdtemp(prefix="sensorframe-"))
        return query(spark, sf_dir)

    return run


# --- inputs -----------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def readings(spark: SparkSession, sf_dir: str, identifier: str = "user_id") -> DataFrame:
    log = events(spark, sf_dir).select(
        "event_type", F.expr(identifier).alias("Identifier"), F.col("ts").alias("Timestamp"), "event_id", "value"
    )
    kind = F.col("event_type")
    return sf.to_readings(log, seq_col="event_id", metric=kind, file=kind, path=kind)


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir, "user_id % 10")


def kinds(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{name}', '{name}s')" for name in KNOWN)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(metric, kind)")


def registry(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('sensors/{name}', '{name}s')" for name in KNOWN)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(topic, kind)")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as Arrow messages of at most 512 rows each."""
    rows = events(spark, sf_dir).select(
        F.concat(F.lit("sensors/"), "event_type").alias("topic"),
        F.expr("event_id div 512").alias("message_id"),
        F.col("ts").alias("arrived"),
        F.col("user_id").alias("identifier"),
        "ts",
        "value",
    )
    return sf.encode_payloads(rows)


def landed(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "landing")
    messages(spark, sf_dir).write.parquet(path)
    return path


def event_stream(spark: SparkSession, sf_dir: str, identifier: str) -> DataFrame:
    stream = (
        spark.readStream.schema(events(spark, sf_dir).schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    return stream.select(F.expr(identifier).alias("identifier"), "ts", "value", F.col("event_id").alias("seq"))


def run_stream(stream: DataFrame, label: str, out: str | None = None) -> DataFrame:
    """Run an append stream over everything available and read what it wrote; ``out`` goes on where an earlier run ended."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


# --- queries ----------------------------------------------------------------


def rounded(df: DataFrame, *names: str) -> DataFrame:
    # Values have two decimals: at eight, a mean of fewer than 128 of them is never a rounding
    # tie, so the last bits of the sum (its order differs between engines) do not show.
    return df.withColumns({name: F.round(name, 8) for name in names})


def resample_query(every_s: int, period_s: int, aggs=("mean",), identifier: str = "user_id % 10", id_col="identifier", **kw):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        windows = sf.resample(readings(spark, sf_dir, identifier), every_s, period_s, aggs, id_col=id_col, **kw)
        return rounded(windows, *aggs)

    return run


def rolling_query(window_size: int, min_periods: int, aggs, identifier: str = "user_id", id_col="identifier", **kw):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sf.rolling(readings(spark, sf_dir, identifier), window_size, min_periods, aggs, id_col=id_col, **kw)

    return run


def table_query(by: str, order: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = readings(spark, sf_dir).select("identifier", "ts", "value", "seq")
        return sf.index_table(table, by, order)

    return run


def read_logs(spark, sf_dir):
    """Write every event type as a log of the usual shape and read all of them back."""
    root = scratch_path(spark, "logs")
    paths = [f"{root}/{name}" for name in EVENT_TYPES]
    for name, path in zip(EVENT_TYPES, paths):
        log = events(spark, sf_dir).where(F.col("event_type") == name)
        log.select(
            F.col("user_id").alias("Identifier"), F.col("ts").alias("Timestamp"), F.col("value").alias(name.title())
        ).write.parquet(path)
    read = sf.read_logs(spark, [*paths, paths[0], f"{root}/missing"], on_error="skip")
    return read.select("metric", "identifier", "ts", "value", "width")


def write_logs(spark, sf_dir, root: str, value_type: str = "double", more=()) -> None:
    """Every event type as one file of a log: the usual columns, more columns, and the value under the type's name."""
    for name in EVENT_TYPES:
        log = events(spark, sf_dir).where(F.col("event_type") == name)
        log.select(
            F.col("user_id").alias("Identifier"), F.col("ts").alias("Timestamp"), *more, F.col("value").cast(value_type).alias(name.title())
        ).coalesce(1).write.mode("append").parquet(root)


def read_raw_logs(spark, sf_dir):
    """One folder of like logs, read with all its columns and types, given twice in different spellings."""
    root = scratch_path(spark, "raw-logs")
    for name in EVENT_TYPES:
        log = events(spark, sf_dir).where(F.col("event_type") == name)
        log.select("user_id", "ts", "props", F.col("value").cast("float").alias("Value")).coalesce(1).write.mode("append").parquet(root)
    raw = sf.read_raw_logs(spark, [root, f"{root}/."])
    in_file = raw.groupBy("_path").agg(F.count("*").alias("file_rows"), F.max("_seq").alias("last_seq"))
    return raw.join(in_file, "_path").select("user_id", "ts", "props", "Value", (F.col("file_rows") - 1 - F.col("last_seq")).alias("gap"), F.col("file_rows"))


def read_logs_mixed_folder(spark, sf_dir):
    """A folder whose files are logs of five different shapes."""
    root = scratch_path(spark, "mixed-logs")
    write_logs(spark, sf_dir, root)
    return sf.read_logs(spark, root).select("metric", "identifier", "ts", "value", "width")


def dedup_raw_logs(spark, sf_dir):
    """Equal logs, and one that differs from them in a column besides time and value."""
    raw = events(spark, sf_dir).select(F.col("event_type").alias("_file"), F.col("event_type").alias("_path"), "event_id", "ts", "value", "props")
    copy = raw.withColumn("_path", F.concat("_path", F.lit("/copy")))
    other = copy.withColumns({"_path": F.concat("_path", F.lit("/noted")), "props": F.lit("{}")})
    kept = sf.dedup_logs(sf.union_logs(raw, copy, other), log_cols=("_path", "_file"), name_col="_file")
    return kept.select(F.col("_path").alias("path"), "event_id", "props")


def union_logs(spark, sf_dir):
    table = readings(spark, sf_dir)
    return sf.union_logs(*[sf.select_logs(table, [name]) for name in EVENT_TYPES]).select(
        "file", "identifier", "ts", "value", "seq"
    )


def with_copies(spark, sf_dir) -> DataFrame:
    """The logs, each once more under another path and once more under another name."""
    table = readings(spark, sf_dir)
    copy = table.withColumn("path", F.concat("path", F.lit("/copy")))
    renamed = table.withColumns(
        {"path": F.concat("path", F.lit("/renamed")), "file": F.concat("file", F.lit("_renamed"))}
    )
    return sf.union_logs(table, copy, renamed)


def fingerprint_logs(spark, sf_dir):
    prints = sf.fingerprint_logs(with_copies(spark, sf_dir))
    return prints.groupBy("metric", "fingerprint").agg(
        F.count("path").alias("copies"), F.min("rows").alias("rows")
    ).drop("fingerprint")


def points_query(**kw):
    def run(spark, sf_dir):
        points = sf.to_points(sf.source_series(readings(spark, sf_dir), id_col="identifier"), **kw)
        return points.select("identifier", "chunk", F.posexplode("points").alias("position", "p")).select(
            "identifier", "chunk", F.col("position").cast("bigint").alias("position"), "p.x", "p.y"
        )

    return run


def series_bundle(spark, sf_dir):
    spec = sf.SeriesSpec(
        resampling=("mean", "median"),
        every_s=6 * HOUR,
        period_s=12 * HOUR,
        rolling=("mean", "median"),
    )
    bundle = sf.series_bundle(dense(spark, sf_dir), spec, id_col="identifier")
    return rounded(bundle, "y")


def table_view(spark, sf_dir):
    table = readings(spark, sf_dir).select("identifier", "ts", "value", "seq")
    view = sf.table_view(table, exclude=[1, 2, 3], by="value", order="desc")
    # the order shows as the partition and the place in it, which rise along the view
    return sf.with_row_index(view.withColumn("at", F.monotonically_increasing_id()), "at", name="place").drop("at")


def format_times(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id",
        sf.format_ts("ts").alias("utc"),
        sf.format_ts("ts", "+03:00").alias("shifted"),
        sf.parse_ts(sf.format_ts("ts")).alias("parsed"),
    )


def epoch_times(spark, sf_dir):
    us = sf.epoch_us("ts")
    return events(spark, sf_dir).select(
        "event_id",
        us.alias("us"),
        sf.epoch_ms("ts").alias("ms"),
        sf.from_epoch(us * 1000, "ns").alias("from_ns"),
        sf.from_epoch(us, "us").alias("from_us"),
        sf.from_epoch(F.expr("event_id * 1000"), "ms").alias("from_ms"),
    )


def hex_ids(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id",
        sf.hex_id("user_id").alias("user_hex"),
        sf.hex_id(-F.col("event_id") - 1).alias("negative_hex"),
    )


def exported_table(spark, sf_dir) -> DataFrame:
    table = sf.exclude_identifiers(events(spark, sf_dir), (), "user_id")
    table = sf.index_table(table, "ts", "desc", seq_col="event_id")
    return table.withColumn("row_index", F.col("row_index").cast("string"))


def export_view(spark, sf_dir):
    return sf.export_view(exported_table(spark, sf_dir), precision=2)


def export_csv(spark, sf_dir):
    path = scratch_path(spark, "export")
    sf.write_export(exported_table(spark, sf_dir).withColumn("blank", F.lit(None)), path, precision=2)
    schema = "event_id string, ts string, user_id string, event_type string, value double, props string, row_index string, blank string"
    return spark.read.csv(path, header=True, schema=schema, quote='"', escape='"').drop("blank")


def route_topics(spark, sf_dir):
    routed, _ = sf.route_topics(messages(spark, sf_dir), registry(spark))
    return routed.select("topic", "message_id", "arrived", "kind")


def dead_letters(spark, sf_dir):
    _, dead = sf.route_topics(messages(spark, sf_dir), registry(spark))
    return dead.select("topic", "message_id", "arrived")


def decode_payloads(spark, sf_dir):
    rows = sf.decode_payloads(messages(spark, sf_dir), "bigint")
    return rows.select("topic", "message_id", "identifier", "ts", "value", "error")


def ingest_stream(spark, sf_dir):
    out = scratch_path(spark, "ingest")
    stream = sf.message_stream(spark, landed(spark, sf_dir))
    sf.ingest_stream(
        stream, out, f"{out}/checkpoint", registry(spark), identifier_type="bigint", available_now=True
    ).awaitTermination()
    rows = spark.read.parquet(f"{out}/readings").select("topic", "identifier", "ts", "value")
    dead = spark.read.parquet(f"{out}/dead_letters")
    dead = dead.select("topic", F.col("message_id").alias("identifier"), F.col("arrived").alias("ts"))
    return rows.unionByName(dead.withColumn("value", F.lit(None).cast("double")))


def latest_stream(spark, sf_dir):
    """Messages land in three micro-batches, the newest first."""
    out, landing = scratch_path(spark, "latest"), scratch_path(spark, "landing")
    every = messages(spark, sf_dir)
    for part in (2, 0, 1):
        every.where(F.col("message_id") % 3 == part).write.mode("append").parquet(landing)
        sf.latest_stream(
            sf.message_stream(spark, landing), out, f"{out}/checkpoint", registry(spark), identifier_type="bigint", available_now=True
        ).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("topic", "message_id", "identifier", "ts", "value")


def appended(spark, sf_dir) -> DataFrame:
    out = scratch_path(spark, "append")
    broken = F.when(F.col("message_id") % 4 == 0, F.lit(b"no arrow stream")).otherwise(F.col("payload"))
    messages(spark, sf_dir).withColumn("payload", broken).write.parquet(f"{out}/landing")
    sf.append_readings_stream(
        sf.message_stream(spark, f"{out}/landing"), f"{out}/rows", f"{out}/checkpoint", registry(spark), identifier_type="bigint", available_now=True
    ).awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def append_stream(spark, sf_dir):
    rows = appended(spark, sf_dir).where("outcome = 'reading'")
    return rows.select("topic", "identifier", "ts", "value")


def append_dead_letters(spark, sf_dir):
    letters = appended(spark, sf_dir).where("outcome = 'dead_letter'")
    return letters.select("topic", "message_id", "arrived", F.col("payload").isNotNull().alias("kept"))


def latest_of_redelivered(spark, sf_dir):
    """Every message delivered twice: newest by message, and newest rows of decoded messages."""
    twice = messages(spark, sf_dir).unionByName(messages(spark, sf_dir))
    rows = sf.latest_batch_per_topic(sf.decode_payloads(twice, "bigint"))
    n = sf.latest_batch_per_topic(twice).groupBy("topic").agg(F.count("*").alias("messages"))
    return rows.join(n, "topic").select("topic", "message_id", "identifier", "ts", "value", "messages")


def decode_nanoseconds(spark, sf_dir):
    """Payloads whose times carry nanoseconds, cut to microseconds."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def encode(batches):
        for batch in batches:
            times = pc.add(pc.multiply(batch.column("us"), 1000), 789).cast(pa.timestamp("ns"))
            log = pa.record_batch({"Identifier": batch.column("event_id"), "Timestamp": times, "Value": batch.column("value")})
            out = []
            for at in range(len(batch)):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, log.schema) as writer:
                    writer.write_batch(log.slice(at, 1))
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_pydict({"message_id": batch.column("event_id"), "payload": pa.array(out, pa.binary())})

    rows = events(spark, sf_dir).select("event_id", sf.epoch_us("ts").alias("us"), "value")
    made = rows.mapInArrow(encode, "message_id bigint, payload binary")
    made = made.select(F.lit("sensors/view").alias("topic"), "message_id", F.lit(None).cast("timestamp_ntz").alias("arrived"), "payload")
    return sf.decode_payloads(made, "bigint").select("message_id", "identifier", "ts", "value", "error")


def resample_stream_query(every_s: int, period_s: int):
    def run(spark, sf_dir):
        stream = event_stream(spark, sf_dir, "user_id % 10")
        windows = sf.resample_stream(stream, every_s, period_s, ("mean", "median"), "10 minutes")
        return rounded(run_stream(windows, "resample-stream"), "mean", "median")

    return run


def rolling_stream(spark, sf_dir):
    stream = event_stream(spark, sf_dir, "user_id")
    return run_stream(sf.rolling_stream(stream, 30, 5, ("mean", "median")), "rolling-stream")


def rolling_stream_batches(spark, sf_dir):
    """Events land in four files by time, one micro-batch each; ties have no tie-breaker.

    Only that no row is lost shows here; ``rolling_stream_ranges`` compares the results.
    """
    landing = scratch_path(spark, "landing")
    ordered = events(spark, sf_dir).repartitionByRange(4, "ts")
    ordered.select(F.col("user_id").alias("identifier"), "ts", "value", F.lit(None).cast("bigint").alias("seq")).write.parquet(landing)
    stream = spark.readStream.schema("identifier bigint, ts timestamp_ntz, value double, seq bigint").option("maxFilesPerTrigger", 1).parquet(landing)
    rolled = run_stream(sf.rolling_stream(stream, 30, 5, ("mean", "median")), "rolling-stream")
    # files of one write have no order, so rows may come late; all are there, and the results agree where none was
    return rolled.select("identifier", "ts", "value", F.col("seq").isNull().alias("untied"))


def rolling_stream_ranges(spark, sf_dir):
    """Events land in four ranges of time, one after another, one run each; all that rolling returns is returned."""
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "rolling-stream")
    rows = events(spark, sf_dir).select(F.col("user_id").alias("identifier"), "ts", "value", F.col("event_id").alias("seq"))
    cuts = rows.select(F.percentile_approx(sf.epoch_us("ts"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000)).first()[0] or []
    place = sum((F.coalesce(sf.epoch_us("ts") > cut, F.lit(False)).cast("int") for cut in cuts), F.lit(0))
    for part in range(4):
        rows.where(place == part).write.mode("append").parquet(landing)
        stream = spark.readStream.schema("identifier bigint, ts timestamp_ntz, value double, seq bigint").parquet(landing)
        rolled = run_stream(sf.rolling_stream(stream, 30, 5, ("mean", "median")), "rolling-stream", out)
    return rolled


def land_disordered(spark, sf_dir, run: Callable[[], DataFrame], landing: str, ranges: int = 4) -> DataFrame:
    """Land events in files that overlap in time, one run each, and at last a row that only tells a far later time.

    A row lands up to one range of time behind its own.
    """
    rows = events(spark, sf_dir).select(F.col("user_id").alias("identifier"), "ts", "value", F.col("event_id").alias("seq"))
    low, width = time_ranges(spark, sf_dir, ranges)
    shift = F.crc32(F.col("seq").cast("string").cast("binary")) / F.lit(float(1 << 32))
    place = F.floor((sf.epoch_us("ts") - low) / F.lit(float(width)) + shift)
    for part in range(ranges + 1):
        rows.where(place == part).write.mode("append").parquet(landing)
        run()
    end = sf.from_epoch(F.lit(low + (2 * ranges + 4) * width))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("identifier", "bigint"), ("value", "double"), ("seq", "bigint"))]
    spark.range(1).select(none[0], end.alias("ts"), *none[1:]).write.mode("append").parquet(landing)
    return run()


def time_ranges(spark, sf_dir, ranges: int) -> tuple[int, int]:
    """First time and width of equal ranges of time that hold all events, in microseconds."""
    us = sf.epoch_us("ts")
    low, high = events(spark, sf_dir).agg(F.min(us), F.max(us)).first()
    return (low or 0), ((high or 0) - (low or 0)) // ranges + 1


def rolling_stream_disordered(spark, sf_dir):
    """Rows that arrive in any order within the watermark's delay get the results of rows in order."""
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "rolling-stream")
    delay_s = 2 * time_ranges(spark, sf_dir, 4)[1] // 1_000_000 + 1

    def run() -> DataFrame:
        stream = spark.readStream.schema("identifier bigint, ts timestamp_ntz, value double, seq bigint").parquet(landing)
        return run_stream(sf.rolling_stream(stream, 30, 5, ("mean", "median"), watermark=f"{delay_s} seconds", bucket_s=10 * DAY), "rolling-stream", out)

    return land_disordered(spark, sf_dir, run, landing)


def resample_stream_leading(spark, sf_dir):
    """Windows of a stream without those that start before their identifier's first pane."""
    stream = event_stream(spark, sf_dir, "user_id")
    windows = sf.resample_stream(stream, 6 * HOUR, 2 * DAY, ("mean", "median"), "10 minutes", leading="drop")
    return rounded(run_stream(windows, "resample-stream"), "mean", "median")


def kept_pages(spark, sf_dir):
    """Two pages of a table that is sorted once: one from the middle on, and the last hundred rows."""
    kept = sf.keep_order(readings(spark, sf_dir).select("identifier", "ts", "value", "seq"), "value", "desc")
    n = kept.count()
    pages = [kept.page(n // 2, 300, name="position"), kept.page(max(0, n - 100), 1000, name="position")]
    return pages[0].unionByName(pages[1])


def kept_pages_deep(spark, sf_dir):
    """The rows from 100,100 on of the line items, sorted once by price."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    items = items.groupBy(*items.columns).agg(F.count("*").alias("times"))
    items = items.withColumn("seq", F.concat_ws("/", "l_orderkey", "l_partkey", "l_suppkey"))
    kept = sf.keep_order(items, "l_extendedprice", "asc")
    pages = [kept.page(100, 50, name="position"), kept.page(40_000, 50, name="position"), kept.page(100_100, 500, name="position")]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).drop("seq")


def kept_catalog(spark, sf_dir):
    """Logs are inserted twice; the second time some are there already and a copy of one is new."""
    root = scratch_path(spark, "kept-logs")
    write_logs(spark, sf_dir, f"{root}/a")
    catalog = sf.KeptCatalog(spark, f"{root}/catalog")
    first = catalog.insert([f"{root}/a"])
    write_logs(spark, sf_dir, f"{root}/b")
    again = catalog.insert([f"{root}/a", f"{root}/b"])
    kept = catalog.readings(by_name=False)
    n = kept.groupBy("metric").agg(F.countDistinct("path").alias("logs"))
    return kept.join(n, "metric").select("metric", "identifier", "ts", "value", "logs", F.lit(first).alias("first"), F.lit(again).alias("again"))


def sensor_registry(spark, sf_dir):
    """Every sensor of the registry with the messages of its topic, and whether they are routed."""
    topics = {"click": "atuc", "view": "dtec", "error": "ddoc/c1", "signup": "ddoc/v2", "purchase": "elsewhere"}
    of_event = F.create_map(*[F.lit(x) for event, topic in topics.items() for x in (f"sensors/{event}", f"sensors/{topic}")])
    sent = messages(spark, sf_dir).withColumn("topic", of_event[F.col("topic")])
    routed, _ = sf.route_topics(sent)
    counted = sent.groupBy("topic").agg(F.count("*").alias("messages")).join(routed.groupBy("topic").agg(F.count("*").alias("routed")), "topic", "left")
    return sf.sensors(spark).join(counted, "topic", "left").fillna(0, ["messages", "routed"])


def landed_topics(spark, sf_dir):
    """Messages land in one folder per topic, and a stream of one topic reads no other."""
    landing = scratch_path(spark, "topics")
    sf.land_messages(messages(spark, sf_dir), landing)
    stream = sf.message_stream(spark, landing, "sensors/view")
    rows = sf.decode_payloads(run_stream(stream, "topic-stream"), "bigint")
    return rows.select("topic", "message_id", "identifier", "ts", "value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    both = ("mean", "median")
    columns = ("identifier", "ts", "value", "seq")
    own = {
        "to_readings": readings,
        "classify": lambda s, d: sf.classify(readings(s, d), kinds(s)).select("seq", "metric", "kind"),
        "read_logs": read_logs,
        "read_raw_logs": read_raw_logs,
        "read_logs_mixed_folder": read_logs_mixed_folder,
        "profile_logs": lambda s, d: sf.profile_logs(readings(s, d)),
        "catalog": lambda s, d: sf.catalog(readings(s, d)),
        "merge_profile": lambda s, d: sf.merge_profile(sf.catalog(readings(s, d)), KNOWN),
        "union_logs": union_logs,
        "select_logs": lambda s, d: sf.select_logs(readings(s, d), KNOWN).select("file", *columns),
        "drop_logs": lambda s, d: sf.drop_logs(readings(s, d), KNOWN).select("file", *columns),
        "fingerprint_logs": fingerprint_logs,
        "dedup_logs": lambda s, d: sf.dedup_logs(with_copies(s, d)).select("path", *columns),
        "dedup_logs_by_content": lambda s, d: sf.dedup_logs(with_copies(s, d), False).select("path", *columns),
        "dedup_raw_logs": dedup_raw_logs,
        "distinct_identifiers": lambda s, d: sf.distinct_identifiers(readings(s, d)),
        "exclude_identifiers": lambda s, d: sf.exclude_identifiers(readings(s, d), [1, 2, 3, 77]).select(*columns),
        "exclude_identifier_table": lambda s, d: sf.exclude_identifiers(
            readings(s, d), readings(s, d).where("value > 300")
        ).select(*columns),
        "exclude_all_identifiers": lambda s, d: sf.exclude_identifiers(readings(s, d), "all").select(*columns),
        "identifier_label": lambda s, d: sf.identifier_range_label(readings(s, d)),
        "table_by_identifier_asc": table_query("identifier", "asc"),
        "table_by_identifier_desc": table_query("identifier", "desc"),
        "table_by_timestamp_asc": table_query("ts", "asc"),
        "table_by_timestamp_desc": table_query("ts", "desc"),
        "table_by_value_asc": table_query("value", "asc"),
        "table_by_value_desc": table_query("value", "desc"),
        "table_page": lambda s, d: sf.page(readings(s, d), 400, 50, "value", "desc").select(*columns),
        "table_view": table_view,
        "kept_pages": kept_pages,
        "kept_pages_deep": kept_pages_deep,
        "kept_catalog": kept_catalog,
        "sensor_registry": sensor_registry,
        "landed_topics": landed_topics,
        "source_series": lambda s, d: sf.source_series(readings(s, d), id_col="identifier"),
        "to_points": points_query(),
        "to_points_chunked": points_query(max_points=25),
        "resample_mean": resample_query(6 * HOUR, 12 * HOUR),
        "resample_median": resample_query(6 * HOUR, 12 * HOUR, ("median",)),
        "resample_both_sparse": resample_query(HOUR, 2 * HOUR, both, "user_id"),
        "resample_tumbling": resample_query(6 * HOUR, 6 * HOUR, both),
        "resample_gapped": resample_query(12 * HOUR, 6 * HOUR, both),
        "resample_uneven": resample_query(6 * HOUR, 15 * HOUR, both),
        "resample_many_windows": resample_query(6 * HOUR, 2 * DAY),
        "resample_keep_leading": resample_query(6 * HOUR, 12 * HOUR, both, leading="keep"),
        "resample_split_windows": resample_query(DAY, 2 * DAY, both, hot_rows=70),
        "resample_by_metric": resample_query(6 * HOUR, 12 * HOUR, both, id_col=None),
        "resample_dense_median": resample_query(HOUR, 30 * DAY, ("median",)),
        "rolling_mean": rolling_query(30, 1, ("mean",)),
        "rolling_by_metric": rolling_query(30, 5, both, "user_id % 10", id_col=None),
        "rolling_median": rolling_query(30, 1, ("median",)),
        "rolling_min_periods": rolling_query(30, 30, both),
        "rolling_split_identifiers": rolling_query(30, 5, both, "user_id % 10", hot_rows=100, chunk_rows=200),
        "rolling_long_window": rolling_query(600, 600, both, "user_id % 10"),
        "series_bundle": series_bundle,
        "format_times": format_times,
        "epoch_times": epoch_times,
        "hex_ids": hex_ids,
        "export_view": export_view,
        "export_csv": export_csv,
        "topic_filter": lambda s, d: sf.topic_filter(messages(s, d), "sensors/view").select("topic", "message_id"),
        "route_topics": route_topics,
        "dead_letters": dead_letters,
        "decode_payloads": decode_payloads,
        "latest_batch_per_topic": lambda s, d: sf.latest_batch_per_topic(messages(s, d)).drop("payload"),
        "ingest_stream": ingest_stream,
        "latest_stream": latest_stream,
        "append_stream": append_stream,
        "append_dead_letters": append_dead_letters,
        "latest_of_redelivered": latest_of_redelivered,
        "decode_nanoseconds": decode_nanoseconds,
        "resample_stream": resample_stream_query(6 * HOUR, 12 * HOUR),
        "resample_stream_gapped": resample_stream_query(12 * HOUR, 6 * HOUR),
        "rolling_stream": rolling_stream,
        "rolling_stream_batches": rolling_stream_batches,
        "rolling_stream_ranges": rolling_stream_ranges,
        "rolling_stream_disordered": rolling_stream_disordered,
        "resample_stream_leading": resample_stream_leading,
    }
    if llm:
        own |= llm.queries() | {"pipeline": corpus_pipeline.run}
    return {name: with_scratch(query) for name, query in own.items()}


def entry(spark: SparkSession) -> DataFrame:
    """Sliding mean and median per sensor on sf0.001."""
    return queries()["series_bundle"](spark, "/root/testdata/sf0.001")


# --- oracles ----------------------------------------------------------------

_READINGS = """
readings as (
    select event_type as path, event_type as file, event_type as metric, user_id as identifier,
           ts, value, event_id as seq, 5 as width
    from events
)"""

_PROFILES = f"""{_READINGS},
profiles as (
    select path, file, metric,
           strftime(min(ts), '%Y-%m-%d %H:%M:%S') as min_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as max_ts,
           count(*) as "rows", max(width) as columns,
           cast(count(*) - count(ts) as bigint) as null_ts, cast(count(*) - count(identifier) as bigint) as null_id
    from readings group by 1, 2, 3
),
positioned as (
    select *, row_number() over (order by metric, min_ts, max_ts, file, path) - 1 as position from profiles
)"""

_MESSAGES = """
messages as (
    select 'sensors/' || event_type as topic, event_id // 512 as message_id, max(ts) as arrived
    from events group by 1, 2
)"""


def _resample_sql(every_s, period_s, aggs=("mean",), identifier="user_id % 10", leading="drop", closed=False, metric=False):
    every, period = every_s * 1_000_000, period_s * 1_000_000
    count = -(-period // every)
    functions = {"mean": "avg", "median": "median"}
    values = ", ".join(f"round({functions[agg]}(value), 8) as {agg}" for agg in aggs)
    keep = "" if leading == "keep" else "and start >= first"
    if closed:
        # the windows a 10 minute watermark has closed; a gapped one closes with its slot
        end = max(every, period) if every > period else period
        keep += f" and start + {end} <= (select max(epoch_us(ts)) // 1000 * 1000 - 600000000 from events)"
    kind, keys = ("event_type as metric, ", "metric, identifier") if metric else ("", "identifier")
    return f"""
with points as (
    select {kind}{identifier} as identifier, value, epoch_us(ts) as us,
           epoch_us(ts) - epoch_us(ts) % {every} as pane
    from events
), firsts as (
    select {keys}, min(pane) as first from points group by {keys}
), assigned as (
    select points.*, first, pane - i * {every} as start
    from points join firsts using ({keys}), range({count}) as r(i)
)
select {keys}, make_timestamp(start) as ts, {values}
from assigned where us < start + {period} {keep}
group by {keys}, start"""


def _rolling_sql(window_size, min_periods, aggs, extra="", identifier="user_id", metric=False):
    functions = {"mean": "avg", "median": "median"}
    values = ", ".join(
        f"case when count(value) over w >= {min_periods} then round({functions[agg]}(value) over w, 6) end"
        f" as rolling_{agg}"
        for agg in aggs
    )
    kind, keys = ("event_type as metric, ", f"event_type, {identifier}") if metric else ("", identifier)
    return f"""
select {kind}{identifier} as identifier, ts, event_id as seq, value, {values}{extra}
from events
window w as (partition by {keys} order by ts, event_id rows between {window_size - 1} preceding and current row)"""


def _table_sql(by, order):
    nulls = "nulls first" if order == "asc" else "nulls last"
    return f"""
with {_READINGS}
select identifier, ts, value, seq, row_number() over (order by {by} {order} {nulls}, seq) - 1 as row_index
from readings"""


def _points_sql(max_points=None):
    chunk = "0" if max_points is None else f"place // {max_points}"
    position = "place" if max_points is None else f"place % {max_points}"
    return f"""
with numbered as (
    select user_id, epoch_us(ts) / 1000.0 as x, value,
           row_number() over (partition by user_id order by ts, event_id) - 1 as place
    from events
)
select user_id as identifier, cast({chunk} as bigint) as chunk, cast({position} as bigint) as position,
       cast(x as double) as x, value as y
from numbered"""


def oracle_sql() -> dict[str, str]:
    """DuckDB equivalents on the same tables."""
    both = ("mean", "median")
    known = "(" + ", ".join(f"'{name}'" for name in KNOWN) + ")"
    rolled = _rolling_sql(30, 1, both, identifier="user_id % 10")
    resampled = _resample_sql(6 * HOUR, 12 * HOUR, both)
    export = """
select lower(to_hex(event_id)) as event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts,
       lower(to_hex(user_id)) as user_id, event_type, round(value, 2) as value, props,
       cast(row_number() over (order by ts desc nulls last, event_id) - 1 as varchar) as row_index
from events"""
    chosen = f"with {_READINGS} select file, identifier, ts, value, seq from readings"
    plain = f"with {_READINGS} select identifier, ts, value, seq from readings"
    own = {
        "to_readings": f"with {_READINGS} select * from readings",
        "classify": f"""
select event_id as seq, event_type as metric,
       case when event_type in {known} then event_type || 's' else 'unknown' end as kind
from events""",
        "read_logs": "select event_type as metric, user_id as identifier, ts, value, 3 as width from events",
        "profile_logs": f"with {_PROFILES} select * from profiles",
        "catalog": f"with {_PROFILES} select * from positioned",
        "merge_profile": f"""
with {_PROFILES}
select max_by(metric, position) as metric, min(min_ts) as min_ts, max(max_ts) as max_ts,
       cast(sum("rows") as bigint) as "rows"
from positioned where file in {known}""",
        "union_logs": chosen,
        "select_logs": f"{chosen} where file in {known}",
        "drop_logs": f"{chosen} where file not in {known}",
        "fingerprint_logs": "select event_type as metric, 3 as copies, count(*) as \"rows\" from events group by 1",
        "dedup_logs": f"""
with {_READINGS}
select path, identifier, ts, value, seq from readings
union all select path || '/renamed', identifier, ts, value, seq from readings""",
        "dedup_logs_by_content": f"with {_READINGS} select path, identifier, ts, value, seq from readings",
        "distinct_identifiers": "select distinct user_id as identifier from events where user_id is not null",
        "exclude_identifiers": f"{plain} where identifier not in (1, 2, 3, 77)",
        "exclude_identifier_table": f"""{plain}
where identifier not in (select user_id from events where value > 300)""",
        "exclude_all_identifiers": f"{plain} where false",
        "identifier_label": """
select lower(to_hex(min(user_id))) || case when count(distinct user_id) < 3 then ',' else '...' end
       || lower(to_hex(max(user_id))) as label
from events""",
        "table_by_identifier_asc": _table_sql("identifier", "asc"),
        "table_by_identifier_desc": _table_sql("identifier", "desc"),
        "table_by_timestamp_asc": _table_sql("ts", "asc"),
        "table_by_timestamp_desc": _table_sql("ts", "desc"),
        "table_by_value_asc": _table_sql("value", "asc"),
        "table_by_value_desc": _table_sql("value", "desc"),
        "table_page": f"{plain} order by value desc nulls last, seq limit 50 offset 400",
        "table_view": f"""
with {_READINGS} select identifier, ts, value, seq, row_number() over (order by value desc nulls last, seq) - 1 as place
from readings where identifier not in (1, 2, 3)""",
        "kept_pages": f"""
with {_READINGS}, placed as (
    select identifier, ts, value, seq, row_number() over (order by value desc nulls last, seq) - 1 as position, count(*) over () as n from readings
)
select identifier, ts, value, seq, position from placed where position >= n // 2 and position < n // 2 + 300
union all select identifier, ts, value, seq, position from placed where position >= n - 100""",
        "kept_pages_deep": """
with items as (
    select l_orderkey, l_partkey, l_suppkey, l_extendedprice, count(*) as times from lineitem group by all
), placed as (
    select *, row_number() over (order by l_extendedprice nulls first, concat_ws('/', l_orderkey, l_partkey, l_suppkey)) - 1 as position from items
)
select * from placed where position between 100 and 149 or position between 40000 and 40049 or position between 100100 and 100599""",
        "kept_catalog": """
select event_type as metric, user_id as identifier, ts, value, cast(1 as bigint) as logs, 5 as first, 5 as again from events""",
        "sensor_registry": f"""
with {_MESSAGES}, sent as (
    select case substr(topic, 9) when 'click' then 'sensors/atuc' when 'view' then 'sensors/dtec' when 'error' then 'sensors/ddoc/c1'
           when 'signup' then 'sensors/ddoc/v2' end as topic, count(*) as messages from messages group by 1
), registry as (
    select * from (values {", ".join(f"('{kind}', 'sensors/{topic}', '{label}', '{text}', '{unit}', {handled})" for kind, topic, label, text, unit, handled in SENSORS)})
             t(kind, topic, label, description, unit, handled)
)
select registry.*, coalesce(messages, 0) as messages, case when handled then coalesce(messages, 0) else 0 end as routed
from registry left join sent using (topic)""",
        "landed_topics": """
select 'sensors/view' as topic, event_id // 512 as message_id, user_id as identifier, ts, value from events where event_type = 'view'""",
        "source_series": """
select user_id as identifier, ts, event_id as seq, cast(epoch_us(ts) / 1000.0 as double) as x, value as y
from events""",
        "to_points": _points_sql(),
        "to_points_chunked": _points_sql(25),
        "resample_mean": _resample_sql(6 * HOUR, 12 * HOUR),
        "resample_median": _resample_sql(6 * HOUR, 12 * HOUR, ("median",)),
        "resample_both_sparse": _resample_sql(HOUR, 2 * HOUR, both, "user_id"),
        "resample_tumbling": _resample_sql(6 * HOUR, 6 * HOUR, both),
        "resample_gapped": _resample_sql(12 * HOUR, 6 * HOUR, both),
        "resample_uneven": _resample_sql(6 * HOUR, 15 * HOUR, both),
        "resample_many_windows": _resample_sql(6 * HOUR, 2 * DAY),
        "resample_keep_leading": _resample_sql(6 * HOUR, 12 * HOUR, both, leading="keep"),
        "resample_split_windows": _resample_sql(DAY, 2 * DAY, both),
        "resample_by_metric": _resample_sql(6 * HOUR, 12 * HOUR, both, metric=True),
        "resample_dense_median": _resample_sql(HOUR, 30 * DAY, ("median",)),
        "rolling_mean": _rolling_sql(30, 1, ("mean",)),
        "rolling_by_metric": _rolling_sql(30, 5, both, identifier="user_id % 10", metric=True),
        "read_raw_logs": """
select user_id, ts, props, cast(value as float) as "Value", cast(0 as bigint) as gap,
       count(*) over (partition by event_type) as file_rows
from events""",
        "read_logs_mixed_folder": """
select event_type as metric, user_id as identifier, ts, value, 3 as width from events""",
        "dedup_raw_logs": """
select event_type as path, event_id, props from events
union all select event_type || '/copy/noted', event_id, '{}' from events""",
        "append_dead_letters": f"""
with {_MESSAGES}
select *, true as kept from messages where substr(topic, 9) not in {known} or message_id % 4 = 0""",
        "latest_of_redelivered": f"""
with {_MESSAGES}, newest as (
    select topic, message_id from messages
    qualify row_number() over (partition by topic order by arrived desc, message_id desc) = 1
)
select topic, message_id, user_id as identifier, ts, value, cast(1 as bigint) as messages
from events join newest on topic = 'sensors/' || event_type and message_id = event_id // 512""",
        "decode_nanoseconds": """
select event_id as message_id, event_id as identifier, ts, value, cast(null as varchar) as error from events""",
        "rolling_stream_batches": "select user_id as identifier, ts, value, true as untied from events",
        "rolling_median": _rolling_sql(30, 1, ("median",)),
        "rolling_min_periods": _rolling_sql(30, 30, both),
        "rolling_split_identifiers": _rolling_sql(30, 5, both, identifier="user_id % 10"),
        "rolling_long_window": _rolling_sql(600, 600, both, identifier="user_id % 10"),
        "series_bundle": f"""
with rolled as ({rolled}), resampled as ({resampled}), series as (
    select 'source' as series, identifier, ts, value as y from rolled
    union all select 'rolling_mean', identifier, ts, rolling_mean from rolled
    union all select 'rolling_median', identifier, ts, rolling_median from rolled
    union all select 'resampling_mean', identifier, ts, mean from resampled
    union all select 'resampling_median', identifier, ts, median from resampled
)
select series, identifier, cast(epoch_us(ts) / 1000.0 as double) as x, round(y, 8) as y from series""",
        "format_times": """
select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as utc,
       strftime(ts + interval 3 hour, '%Y-%m-%d %H:%M:%S') as shifted, date_trunc('second', ts) as parsed
from events""",
        "epoch_times": """
select event_id, epoch_us(ts) as us, cast(epoch_us(ts) / 1000.0 as double) as ms, ts as from_ns, ts as from_us,
       make_timestamp(event_id * 1000 * 1000) as from_ms
from events""",
        "hex_ids": """
select event_id, lower(to_hex(user_id)) as user_hex, lower(to_hex(-event_id - 1)) as negative_hex from events""",
        "export_view": export,
        "export_csv": export,
        "topic_filter": f"with {_MESSAGES} select topic, message_id from messages where topic = 'sensors/view'",
        "route_topics": f"""
with {_MESSAGES} select *, substr(topic, 9) || 's' as kind from messages where substr(topic, 9) in {known}""",
        "dead_letters": f"with {_MESSAGES} select * from messages where substr(topic, 9) not in {known}",
        "decode_payloads": """
select 'sensors/' || event_type as topic, event_id // 512 as message_id, user_id as identifier, ts, value,
       cast(null as varchar) as error
from events""",
        "latest_batch_per_topic": f"""
with {_MESSAGES} select * from messages
qualify row_number() over (partition by topic order by arrived desc, message_id desc) = 1""",
        "ingest_stream": f"""
with {_MESSAGES}
select 'sensors/' || event_type as topic, user_id as identifier, ts, value from events where event_type in {known}
union all select topic, message_id, arrived, null from messages where substr(topic, 9) not in {known}""",
        "latest_stream": f"""
with {_MESSAGES}, newest as (
    select topic, message_id from messages
    qualify row_number() over (partition by topic order by arrived desc, message_id desc) = 1
)
select topic, message_id, user_id as identifier, ts, value
from events join newest on topic = 'sensors/' || event_type and message_id = event_id // 512
where event_type in {known}""",
        "append_stream": f"""
select 'sensors/' || event_type as topic, user_id as identifier, ts, value from events
where event_type in {known} and event_id // 512 % 4 <> 0""",
        "resample_stream": _resample_sql(6 * HOUR, 12 * HOUR, both, leading="keep", closed=True),
        "resample_stream_gapped": _resample_sql(12 * HOUR, 6 * HOUR, both, leading="keep", closed=True),
        "resample_stream_leading": _resample_sql(6 * HOUR, 2 * DAY, both, "user_id", closed=True),
        "rolling_stream": _rolling_sql(30, 5, both, extra=", false as late"),
        "rolling_stream_ranges": _rolling_sql(30, 5, both, extra=", false as late"),
        "rolling_stream_disordered": _rolling_sql(30, 5, both, extra=", false as late"),
    }
    if llm:
        own |= llm.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            own["pipeline"] = corpus_pipeline.ORACLE_SQL
    return own
