"""Parquet sensor logs into the canonical readings table."""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.time import instant_to_ntz
from ..schema import require_columns
from ..scratch import pin

log = logging.getLogger(__name__)

# Metric name -> kind of log.
METRIC_KINDS = {
    "temperature": "temperature",
    "turbidity": "turbidity",
}


def metric_kinds(spark: SparkSession) -> DataFrame:
    """``(metric, kind)`` dimension of the known metrics."""
    rows = ", ".join(f"('{metric}', '{kind}')" for metric, kind in METRIC_KINDS.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(metric, kind)")


def to_readings(
    df: DataFrame,
    *,
    id_col: str = "Identifier",
    ts_col: str = "Timestamp",
    value_col: str | None = None,
    seq_col: str | None = None,
    metric=None,
    file=None,
    path=None,
) -> DataFrame:
    """One log of any shape as canonical readings.

    The value is the last column unless named, and its lower-cased name is the
    metric. ``metric``, ``file`` and ``path`` take a column or a text.
    """
    value_col = value_col or df.columns[-1]
    require_columns(df, id_col, ts_col, value_col)
    id_type, ts_type = df.schema[id_col].dataType, df.schema[ts_col].dataType
    if not isinstance(ts_type, (T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"{ts_col} must be a timestamp, got {ts_type.simpleString()}")
    if not isinstance(id_type, (T.IntegralType, T.DecimalType)):
        raise ValueError(f"{id_col} must be a whole number, got {id_type.simpleString()}")

    def text(given, default=None):
        given = default if given is None else given
        return (F.lit(given) if given is None or isinstance(given, str) else given).cast("string")

    identifier = F.col(id_col)
    return df.select(
        text(path, file).alias("path"),
        text(file).alias("file"),
        text(metric, value_col.lower()).alias("metric"),
        (identifier if isinstance(id_type, T.DecimalType) else identifier.cast("bigint")).alias("identifier"),
        (F.col(ts_col) if isinstance(ts_type, T.TimestampNTZType) else instant_to_ntz(ts_col)).alias("ts"),
        F.col(value_col).cast("double").alias("value"),
        (F.col(seq_col) if seq_col else F.lit(None)).cast("bigint").alias("seq"),
        F.lit(len(df.columns)).alias("width"),
    )


def classify(readings: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """Add ``kind`` by metric name; ``unknown`` where the dimension has no entry.

    The dimension is an inline table, so Catalyst knows its size and broadcasts
    it; a large dimension of your own is joined by a shuffle.
    """
    kinds = metric_kinds(readings.sparkSession) if kinds is None else kinds
    joined = readings.join(kinds.select("metric", "kind"), "metric", "left")
    return joined.select(*readings.columns, F.coalesce("kind", F.lit("unknown")).alias("kind"))


def _shapes(
    spark: SparkSession, paths: list[str], on_error: str, check
) -> list[tuple[T.StructType, list[str]]]:
    """Logs by schema: ``(schema, paths)``, each file in one of them only.

    The schema of a path is compared with what Spark merges from all its footers, in one job over its files; only a
    path that mixes shapes is taken apart file by file. A file reached twice, by whatever spelling, is read once.
    """

    failures = (PySparkException, Py4JJavaError, ValueError)

    def whole(path: str) -> tuple[T.StructType, str, list[str]]:
        one = spark.read.option("mergeSchema", False).parquet(path)
        check(one)
        return one.schema, path, one.inputFiles()

    def look(path: str) -> list | Exception:
        """The shapes below a path; failures of single files are among them, or raised."""
        try:
            found = whole(path)
            if len(found[2]) < 2 or spark.read.option("mergeSchema", True).parquet(path).schema == found[0]:
                return [found]
        except failures as reason:  # also where one column has two types
            failure = reason
        else:
            failure = None
        try:
            files = spark.read.format("binaryFile").load(path).inputFiles()
        except failures as reason:
            return failure or reason
        if len(files) < 2:
            return failure
        parts = []
        for file in files:
            try:
                parts.append(whole(file))
            except failures as reason:
                if on_error == "raise":
                    return reason
                log.warning("skipped %s: %s", file, str(reason).splitlines()[0])
        return parts

    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(look, paths))
    shapes: dict[str, tuple[T.StructType, list[tuple[str, list[str]]]]] = {}
    for path, parts in zip(paths, found):
        if isinstance(parts, Exception):
            if on_error == "raise":
                raise parts
            log.warning("skipped %s: %s", path, str(parts).splitlines()[0])
            continue
        for schema, part, files in parts:
            shapes.setdefault(schema.json(), (schema, []))[1].append((part, files))
    if not shapes:
        raise ValueError("no readable log among the paths")
    out = []
    for schema, members in shapes.values():
        files = [file for _, own in members for file in own]
        distinct = list(dict.fromkeys(files))
        out.append((schema, [part for part, _ in members] if len(distinct) == len(files) else distinct))
    return out


def _placed(spark: SparkSession, schema: T.StructType, members: list[str], on_error: str) -> DataFrame:
    """All columns of the logs of one schema, with ``__sf_path``, ``__sf_file`` and ``__sf_seq``.

    With ``on_error="skip"`` a file with damaged pages is left out as a whole: one pass reads all cells and compares the
    rows that could be read with those the footers promise.
    """
    raw = spark.read.schema(schema).parquet(*members)
    tolerant = spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(*members)
    placed = (tolerant if on_error == "skip" else raw).select(
        "*",
        F.col("_metadata.file_path").alias("__sf_path"),
        F.col("_metadata.file_name").alias("__sf_file"),
        F.col("_metadata.row_index").alias("__sf_seq"),
    )
    if on_error == "raise":
        return placed
    cells = F.xxhash64(*[F.col(f"`{c}`") for c in raw.columns])
    by_file = F.col("_metadata.file_path").alias("file")
    read = tolerant.groupBy(by_file).agg(F.count("*").alias("read"), F.bit_xor(cells).alias("cells"))
    promised = raw.groupBy(by_file).agg(F.count("*").alias("promised"))
    # one row per damaged file
    damaged = promised.join(read, "file", "left").where("read is null or read < promised or cells is null and read > 0")
    damaged = pin(damaged.select(F.col("file").alias("__sf_damaged")), "damaged-files")
    for row in damaged.limit(20).collect():
        log.warning("skipped %s: damaged pages", row[0])
    return placed.join(damaged, F.col("__sf_path") == F.col("__sf_damaged"), "left_anti")


def _path_list(paths, on_error: str) -> list[str]:
    if on_error not in ("raise", "skip"):
        raise ValueError(f"on_error must be 'raise' or 'skip', got {on_error!r}")
    return list(dict.fromkeys([paths] if isinstance(paths, str) else paths))


def read_raw_logs(spark: SparkSession, paths, on_error: str = "raise") -> DataFrame:
    """Read Parquet logs of one shape as they are: all columns, their names and types, and ``_path, _file, _seq``.

    ``paths`` are files, folders or globs; logs of different shapes raise ``ValueError``, as a strict union does. See
    ``read_logs`` for ``on_error``; ``_seq`` is the row's place in its file.
    """
    shapes = _shapes(spark, _path_list(paths, on_error), on_error, lambda df: None)
    if len(shapes) > 1:
        raise ValueError("logs of different shapes: " + "; ".join(schema.simpleString() for schema, _ in shapes))
    placed = _placed(spark, *shapes[0], on_error)
    return placed.withColumnsRenamed({"__sf_path": "_path", "__sf_file": "_file", "__sf_seq": "_seq"})


def read_logs(
    spark: SparkSession,
    paths,
    on_error: str = "raise",
    *,
    id_col: str = "Identifier",
    ts_col: str = "Timestamp",
) -> DataFrame:
    """Read Parquet logs into one readings table.

    ``paths`` are files, folders or globs. Files with equal schemas share one
    scan, so thousands of like logs make a single source; a folder may mix log
    shapes, and a file that several paths reach is read once. ``on_error="skip"``
    leaves out what is not a readable log, damaged files as a whole (found by
    one extra pass over all cells), and logs the reason. ``seq`` is the row's
    place in its file.
    """

    def check(raw: DataFrame) -> None:
        to_readings(raw, id_col=id_col, ts_col=ts_col)

    readings = []
    for schema, members in _shapes(spark, _path_list(paths, on_error), on_error, check):
        one = to_readings(
            _placed(spark, schema, members, on_error),
            id_col=id_col,
            ts_col=ts_col,
            value_col=schema.names[-1],
            seq_col="__sf_seq",
            file=F.col("__sf_file"),
            path=F.col("__sf_path"),
        )
        readings.append(one.withColumn("width", F.lit(len(schema))))
    if len({r.schema["identifier"].dataType for r in readings}) > 1:
        readings = [r.withColumn("identifier", F.col("identifier").cast("decimal(20,0)")) for r in readings]
    result = readings[0]
    for more in readings[1:]:
        result = result.unionByName(more)
    return result
