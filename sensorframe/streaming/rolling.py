"""Rolling statistics on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.time import epoch_us, from_epoch, ntz_to_instant
from ..operators.rolling_kernel import rolling_columns
from ..schema import (
    AGGREGATES,
    ROUND_DECIMALS,
    has_point,
    require_aggregates,
    require_columns,
    require_positive,
)
from .state import GROUPS, group_of, pack, pack_frame, unpack, use_rocksdb


#: Stands for a null tie-breaker, which comes before all others.
_NO_SEQ = -(1 << 63)
_ROW = ["id", "us", "seq", "v", "missing"]


class _Answered:
    """The identifiers of a group that were answered: the last ``(us, seq)``, the last values, and when rows came (ms)."""

    def __init__(self, data: bytes | None):
        self.ids = pd.Series([], dtype=object)
        self.us = self.seq = self.seen = self.count = np.zeros(0, "int64")
        self.tail = pa.array([], pa.float64())
        if data:
            table = unpack(data)
            self.ids = table["id"].to_pandas()
            self.us, self.seq, self.seen = (table[c].to_numpy().copy() for c in ("us", "seq", "seen"))
            values = table["last_values"].combine_chunks()
            self.count = values.value_lengths().to_numpy().astype("int64")
            self.tail = values.flatten()

    def __len__(self) -> int:
        return len(self.ids)

    def _codes(self, rows: pd.DataFrame) -> tuple[np.ndarray, pd.Series]:
        """A number for the identifier of each row; those that are known come first, in their order."""
        ids = pd.concat([self.ids, rows["id"]], ignore_index=True) if len(self) else rows["id"].reset_index(drop=True)
        codes, _ = pd.factorize(ids, use_na_sentinel=False)
        of_code = ids[~pd.Series(codes).duplicated().to_numpy()].reset_index(drop=True)
        return codes[len(self) :], of_code

    def late(self, rows: pd.DataFrame) -> np.ndarray:
        """Which rows come before or at what was already answered."""
        if not len(self):
            return np.zeros(len(rows), bool)
        codes, _ = self._codes(rows)
        known = codes < len(self)
        at = np.where(known, codes, 0)
        us, seq = rows["us"].to_numpy(), rows["seq"].to_numpy()
        return known & ((us < self.us[at]) | ((us == self.us[at]) & (seq <= self.seq[at])))

    def roll(self, rows: pd.DataFrame, window_size: int, min_periods: int, aggs, now: int = 0) -> pd.DataFrame:
        """``rows`` in order of identifier and time, with their rolling columns; the state goes on behind them."""
        codes, of_code = self._codes(rows)
        order = np.lexsort((rows["seq"].to_numpy(), rows["us"].to_numpy(), codes))
        rows, codes = rows.iloc[order].reset_index(drop=True), codes[order]
        # all last values, then the new rows: sorted by identifier, what was there comes first
        before = np.repeat(np.arange(len(self)), self.count)
        code = np.concatenate([before, codes])
        series = pa.concat_arrays([self.tail, pa.array(rows["v"].to_numpy(), pa.float64(), mask=rows["missing"].to_numpy(), from_pandas=False)])
        place = np.argsort(code, kind="stable")
        code, series = code[place], series.take(pa.array(place))
        touched = np.zeros(len(of_code), bool)
        touched[codes] = True
        rolled = touched[code]  # identifiers without a new row need no results
        own = code[rolled]
        starts = np.searchsorted(own, own)
        columns = rolling_columns(series.filter(pa.array(rolled)), starts, window_size, min_periods, aggs)
        fresh = pa.array((place >= len(before))[rolled])
        out = {}
        for name, column in columns.items():
            column = column.filter(fresh)
            out[name] = column.to_numpy(zero_copy_only=False)
            out[f"{name}_nan"] = pc.fill_null(pc.is_nan(column), False).to_numpy(zero_copy_only=False)  # pandas gives null back for NaN
        left = np.searchsorted(code, code, "right") - np.arange(len(code))  # rows from here to the identifier's last
        kept = left <= window_size - 1
        self.tail, self.count = series.filter(pa.array(kept)), np.bincount(code[kept], minlength=len(of_code)).astype("int64")
        grow = len(of_code) - len(self)
        self.us, self.seq, self.seen = (np.concatenate([x, np.zeros(grow, "int64")]) for x in (self.us, self.seq, self.seen))
        last = np.flatnonzero(np.append(codes[1:] != codes[:-1], True))
        self.us[codes[last]], self.seq[codes[last]] = rows["us"].to_numpy()[last], rows["seq"].to_numpy()[last]
        self.ids = of_code
        self.seen[codes] = now
        return rows.assign(**out)

    def came(self, rows: pd.DataFrame, now: int) -> None:
        """Late rows, too, show that their identifier lives."""
        self.seen[self._codes(rows)[0]] = now

    def forget(self, before: int) -> None:
        """Leave out identifiers that brought no row after ``before``."""
        stays = self.seen > before
        if not stays.all():
            self.tail = self.tail.filter(pa.array(np.repeat(stays, self.count)))
            self.ids = self.ids[stays].reset_index(drop=True)
            self.us, self.seq, self.seen, self.count = (x[stays] for x in (self.us, self.seq, self.seen, self.count))

    def pack(self) -> bytes:
        offsets = pa.array(np.concatenate([[0], np.cumsum(self.count)]), pa.int32())
        values = pa.ListArray.from_arrays(offsets, self.tail)
        ids = pa.array(self.ids, from_pandas=True)
        return pack(pa.table({"id": ids, "us": self.us, "seq": self.seq, "seen": self.seen, "last_values": values}))


def _unanswered(rows: pd.DataFrame, aggs) -> pd.DataFrame:
    names = [f"rolling_{agg}" for agg in aggs]
    return rows.assign(**{name: np.nan for name in names}, **{f"{name}_nan": False for name in names})


class _InOrder(StatefulProcessor):
    """Rows wait in the state, by time bucket, until the watermark has passed their bucket's end.

    ``waiting`` holds a bucket's rows as they came, one entry per Arrow batch; a timer at the bucket's end brings them out,
    sorted. So a task holds one batch or one bucket of one group of identifiers at a time.
    """

    def __init__(self, bucket_s: int, window_size: int, min_periods: int, aggs: tuple[str, ...], columns: list[str]):
        self.bucket_ms, self.window_size, self.min_periods, self.aggs, self.columns = 1000 * bucket_s, window_size, min_periods, aggs, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket bigint, part bigint", "rows binary")
        self.parts = handle.getValueState("parts", "buckets array<bigint>, parts array<bigint>")
        self.answered = handle.getValueState("answered", "identifiers binary")

    def _load(self) -> tuple[_Answered, dict[int, int]]:
        stored = self.answered.get()
        return _Answered(stored[0] if stored else None), dict(zip(*(self.parts.get() or ([], []))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] < 0:  # such rows only tell the time
            for _ in rows:
                pass
            return
        answered, parts = self._load()
        for frame in rows:
            late = answered.late(frame)
            if late.any():
                yield _unanswered(frame[late], self.aggs).assign(late=True)[self.columns]
            for bucket, own in frame[~late].groupby(frame["us"] // (1000 * self.bucket_ms)):
                bucket = int(bucket)
                if bucket not in parts:
                    self.handle.registerTimer((bucket + 1) * self.bucket_ms)
                part = parts[bucket] = parts.get(bucket, 0) + 1
                self.waiting.updateValue((bucket, part), (pack_frame(own[_ROW]),))
        self.parts.update((list(parts), list(parts.values())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bucket = expiredTimerInfo.getExpiryTimeInMs() // self.bucket_ms - 1
        answered, parts = self._load()
        frames = []
        for part in range(1, parts.pop(bucket) + 1):
            frames.append(unpack(self.waiting.getValue((bucket, part))[0]).to_pandas())
            self.waiting.removeKey((bucket, part))
        out = answered.roll(pd.concat(frames, ignore_index=True), self.window_size, self.min_periods, self.aggs)
        self.answered.update((answered.pack(),))
        self.parts.update((list(parts), list(parts.values())))
        yield out.assign(late=False)[self.columns]


def rolling_stream(
    df: DataFrame,
    window_size: int = 30,
    min_periods: int = 1,
    aggs=("mean",),
    *,
    id_col: str = "identifier",
    ts_col: str = "ts",
    value_col: str = "value",
    seq_col: str = "seq",
    idle_timeout_s: int | None = None,
    watermark: str | None = None,
    bucket_s: int = 60,
    groups: int = GROUPS,
) -> DataFrame:
    """Streaming form of ``rolling`` for append mode.

    With ``watermark``, the longest delay of a row, rows wait until the watermark has passed the end of their bucket of
    ``bucket_s`` seconds and come out in order, so whatever order they arrive in within the delay, results are those of
    ``rolling``. The rows wait in the state store, which must be RocksDB (the session is set to it where it has another);
    one bucket of a group of identifiers is in memory at a time. A row without identifier brings no result, but its time moves the
    watermark. Rows are from 1970 on.

    Without ``watermark`` rows are answered at once. State per identifier: the last ``window_size - 1`` values and the last
    ``(ts, seq)``. Each micro-batch is sorted per identifier; a row older than
    the last one already answered cannot be placed any more and comes out with
    ``late = true`` and null results, so no row is lost. One group's part
    of a micro-batch is in one task's memory: bound it by the files per trigger
    of the source or by more groups. ``idle_timeout_s`` (seconds) forgets identifiers that
    bring no row for so long; without it their state stays.

    Identifiers are dealt to ``groups`` groups by a hash; one call of Python
    answers a group and its state is read and written as one. So ``groups``
    must stay the same over the life of a checkpoint.

    Returns ``(identifier, ts, seq, value, rolling_mean?, rolling_median?, late)``.
    """
    aggs = tuple(agg for agg in AGGREGATES if agg in require_aggregates(aggs))
    require_positive(window_size=window_size, min_periods=min_periods, groups=groups)
    if min_periods > window_size:
        raise ValueError(f"min_periods {min_periods} exceeds window_size {window_size}")
    require_columns(df, id_col, ts_col, value_col, seq_col)
    results = [f"rolling_{agg}" for agg in aggs]

    def advance(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if idle_timeout_s else 0
        answered = _Answered(state.get[0] if state.exists else None)
        if not state.hasTimedOut:
            rows = pd.concat(list(chunks), ignore_index=True)
            late = answered.late(rows)
            waiting = _unanswered(rows[late], aggs)
            if late.any():
                answered.came(rows[late], now)
            if not late.all():
                done = answered.roll(rows[~late], window_size, min_periods, aggs, now)
                yield done.assign(late=False)[columns]
            if late.any():
                yield waiting.assign(late=True)[columns]
        if idle_timeout_s:
            answered.forget(now - 1000 * idle_timeout_s)
            if not len(answered):
                state.remove()
                return
            state.setTimeoutDuration(max(1, int(answered.seen.min()) + 1000 * idle_timeout_s - now))
        state.update((answered.pack(),))

    columns = ["id", "us", "seq", "v", "missing", *results, *[f"{name}_nan" for name in results], "late"]
    if watermark:
        if idle_timeout_s:
            raise ValueError("idle_timeout_s is for streams without watermark")
        require_positive(bucket_s=bucket_s)
        use_rocksdb(df.sparkSession)
        # Rows without identifier go on, so that no filter is pushed below the watermark.
        df = df.withColumn("__sf_at", ntz_to_instant(ts_col)).withWatermark("__sf_at", watermark)
    points = df.where(F.col(ts_col).isNotNull() if watermark else has_point([id_col], ts_col)).select(
        group_of(id_col, groups).alias("sf_group"),
        F.col(id_col).alias("id"),
        epoch_us(ts_col).alias("us"),
        F.coalesce(F.col(seq_col).cast("bigint"), F.lit(_NO_SEQ)).alias("seq"),
        F.col(value_col).cast("double").alias("v"),
        F.col(value_col).isNull().alias("missing"),
    )
    id_type = points.schema["id"].dataType.simpleString()
    output = "".join(f", {name} double" for name in results) + "".join(f", {name}_nan boolean" for name in results)
    nan = F.lit(float("nan"))
    schema = f"id {id_type}, us bigint, seq bigint, v double, missing boolean{output}, late boolean"
    if watermark:
        processor = _InOrder(bucket_s, window_size, min_periods, aggs, columns)
        rolled = points.groupBy("sf_group").transformWithStateInPandas(processor, schema, "append", "eventTime")
    else:
        rolled = points.groupBy("sf_group").applyInPandasWithState(
            advance,
            schema,
            "identifiers binary",
            "append",
            GroupStateTimeout.ProcessingTimeTimeout if idle_timeout_s else GroupStateTimeout.NoTimeout,
        )
    return rolled.select(
        F.col("id").alias(id_col),
        from_epoch("us").alias(ts_col),
        F.nullif("seq", F.lit(_NO_SEQ)).alias(seq_col),
        F.when(~F.col("missing"), F.coalesce("v", nan)).alias(value_col),
        *[F.when(F.col(f"{name}_nan"), nan).otherwise(F.round(name, ROUND_DECIMALS)).alias(name) for name in results],
        "late",
    )
