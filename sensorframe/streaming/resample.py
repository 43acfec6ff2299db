"""Resampling on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.time import from_epoch, instant_to_ntz, ntz_to_instant
from ..operators.resample import floor_to
from ..schema import require_aggregates, require_columns, require_positive
from .state import GROUPS, group_of, pack_frame, unpack, use_rocksdb


class _AfterFirstPane(StatefulProcessor):
    """Lets windows pass that start with or after their identifier's first pane; these panes are a group's state.

    Windows come when the watermark has passed their end, so those that hold an identifier's first row come no later
    than any other of its windows. Only in the micro-batch that brings them are windows held, those of new identifiers.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "panes binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] < 0:  # windows without identifier were left out before
            for _ in rows:
                pass
            return
        stored = self.first.get()
        known = unpack(stored[0]).to_pandas() if stored else None
        fresh = []
        for frame in rows:
            frame = frame.drop(columns="sf_group")
            if known is not None:
                pane = frame["id"].map(known.set_index("id")["pane"])
                yield frame[(frame["start"] >= pane).to_numpy()].drop(columns="pane")
                frame = frame[pane.isna().to_numpy()]
            if len(frame):
                fresh.append(frame)
        if not fresh:
            return
        frame = pd.concat(fresh, ignore_index=True)
        first = frame.groupby("id", sort=False, dropna=False)["pane"].transform("min")
        yield frame[frame["start"] >= first].drop(columns="pane")
        found = pd.DataFrame({"id": frame["id"], "pane": first}).drop_duplicates("id")
        self.first.update((pack_frame(found if known is None else pd.concat([known, found], ignore_index=True)),))


def resample_stream(
    df: DataFrame,
    every_s: int = 60,
    period_s: int = 120,
    aggs=("mean",),
    watermark: str = "10 minutes",
    leading: str = "keep",
    *,
    id_col: str = "identifier",
    ts_col: str = "ts",
    value_col: str = "value",
    groups: int = GROUPS,
) -> DataFrame:
    """Streaming form of ``resample`` for append mode: ``(identifier, ts, mean?, median?)``.

    A window is emitted once the watermark has passed its end. Rows later than
    the watermark are dropped by Spark; choose ``watermark`` above the longest
    delay. The mean keeps two numbers per open window; the median keeps the
    window's distinct values in the state store. A row without identifier only
    moves the watermark.

    ``leading="drop"`` leaves out windows that start before the pane of the
    identifier's first row, as ``resample`` does, by a second stateful operator
    behind the windows; it needs the RocksDB state store, which the session is
    set to where it has another. Identifiers share its state in ``groups``
    groups, and a task holds the windows that one micro-batch closes of a
    group's new identifiers.
    """
    if leading not in ("drop", "keep"):
        raise ValueError(f"leading must be 'drop' or 'keep', got {leading!r}")
    aggs = require_aggregates(aggs)
    require_positive(every_s=every_s, period_s=period_s, groups=groups)
    require_columns(df, id_col, ts_col, value_col)
    points = df.where(F.col(ts_col).isNotNull()).select(
        id_col, ntz_to_instant(ts_col).alias("at"), F.col(value_col).cast("double").alias("v")
    )
    points = points.withWatermark("at", watermark)
    every = f"{every_s} seconds"
    if period_s >= every_s:
        window = F.window("at", f"{period_s} seconds", every)
    else:
        window = F.window("at", every)
        since_start = F.pmod(F.unix_micros("at"), F.lit(every_s * 1_000_000))
        points = points.where(since_start < period_s * 1_000_000)
    functions = {"mean": F.avg, "median": F.median}
    # An aggregate tells whether there is an identifier: a plain filter would be pushed below the watermark.
    known = F.count(id_col).alias("known")
    named = [functions[a]("v").alias(a) for a in aggs]
    if leading == "keep" or period_s <= every_s:  # without overlap no window starts early
        grouped = points.groupBy(id_col, window.alias("w")).agg(known, *named).where("known > 0")
        return grouped.select(id_col, instant_to_ntz("w.start").alias(ts_col), *aggs)
    use_rocksdb(df.sparkSession)
    pane = floor_to(F.unix_micros(F.min("at")), every_s * 1_000_000)
    windows = points.groupBy(F.col(id_col).alias("id"), window.alias("w")).agg(known, pane.alias("pane"), *named).where("known > 0")
    windows = windows.select(group_of("id", groups).alias("sf_group"), "id", F.unix_micros("w.start").alias("start"), "pane", *aggs, *[F.isnan(a).alias(f"{a}_nan") for a in aggs])
    id_type = windows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, start bigint" + "".join(f", {a} double" for a in aggs) + "".join(f", {a}_nan boolean" for a in aggs)
    kept = windows.groupBy("sf_group").transformWithStateInPandas(_AfterFirstPane(), schema, "append", "none")
    values = [F.when(F.col(f"{a}_nan"), F.lit(float("nan"))).otherwise(F.col(a)).alias(a) for a in aggs]  # pandas gives null back for NaN
    return kept.select(F.col("id").alias(id_col), from_epoch("start").alias(ts_col), *values)
