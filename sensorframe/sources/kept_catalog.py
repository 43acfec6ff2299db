"""A catalog of logs kept on disk: logs that it knows are not read again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.catalog import LOG, profile_and_print
from .logs import read_logs

_FOUND = "path string, length bigint, modified timestamp"
_ENTRY = (
    "path string, file string, metric string, min_ts string, max_ts string, rows bigint, columns int, null_ts bigint, "
    "null_id bigint, fingerprint string, length bigint, modified timestamp, inserted bigint"
)


@dataclass(frozen=True)
class KeptCatalog:
    """Profiles and content fingerprints of logs below ``store``; one writer at a time."""

    spark: SparkSession
    store: str

    def entries(self) -> DataFrame:
        """One row per known file: profile, fingerprint, and the size and time by which a changed file is told."""
        self.spark.createDataFrame([], _ENTRY).write.mode("append").parquet(self.store)  # so that there is a folder
        stored = self.spark.read.schema(_ENTRY).parquet(self.store)
        newest = stored.groupBy("path").agg(F.max("inserted").alias("inserted"))
        return stored.join(newest, ["path", "inserted"], "left_semi")

    def found(self, paths) -> DataFrame:
        """The files below ``paths`` as ``path, length, modified``; their contents are not read."""
        paths = [paths] if isinstance(paths, str) else list(paths)
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(paths)
        return files.select(F.col("_metadata.file_path").alias("path"), "length", F.col("modificationTime").alias("modified")).distinct()

    def insert(self, paths, on_error: str = "raise") -> int:
        """Read, profile and fingerprint the files below ``paths`` that are new or changed; returns how many logs that were."""
        known = self.entries()
        same = ["path", "length", "modified"]
        new = self.found(paths).join(known.select(*same), same, "left_anti").collect()  # one row per new file
        if not new:
            return 0
        readings = read_logs(self.spark, [row["path"] for row in new], on_error)
        found = self.spark.createDataFrame(new, _FOUND)
        batch = (known.agg(F.max("inserted")).first()[0] or 0) + 1
        rows = profile_and_print(readings).join(found, "path").withColumn("inserted", F.lit(batch).cast("bigint"))
        names = [entry.split()[0] for entry in _ENTRY.split(", ")]
        rows.select(*names).write.mode("append").parquet(self.store)
        return len(new)

    def distinct_logs(self, by_name: bool = True) -> DataFrame:
        """The entries of which ``dedup_logs`` would keep the logs: of equal ones the first path."""
        entries = self.entries()
        groups = [*(["file"] if by_name else []), "metric", "rows", "fingerprint"]
        kept = entries.groupBy(*groups).agg(F.min("path").alias("path"))
        return entries.join(kept.select("path"), "path", "left_semi").select(*LOG, *[c for c in entries.columns if c not in LOG])

    def readings(self, by_name: bool = True, on_error: str = "raise") -> DataFrame:
        """The readings of the distinct logs."""
        return read_logs(self.spark, [row["path"] for row in self.distinct_logs(by_name).select("path").collect()], on_error)
