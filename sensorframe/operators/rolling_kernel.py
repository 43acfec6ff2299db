"""Rolling statistics over sorted Arrow batches, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pandas.api.indexers import BaseIndexer


class _Frames(BaseIndexer):
    """Frames given by their first row and the row after their last."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.first, self.after


def rolling_columns(
    values: pa.Array, group_start: np.ndarray, window_size: int, min_periods: int, aggs
) -> dict[str, pa.Array]:
    """``rolling_mean`` / ``rolling_median`` of rows in order; frames stay inside their group.

    ``group_start`` is the position of the first row of each row's group.
    pandas skips NaN and infinities inside rolling windows, Spark does not. So
    the mean sums the finite values only and the others are counted per frame
    and put back; the median then runs on value ranks. Nulls are told from NaN
    by the Arrow validity mask.
    """
    null = values.is_null().to_numpy(zero_copy_only=False)
    numbers = values.fill_null(0.0).to_numpy(zero_copy_only=False)
    here = np.arange(len(numbers), dtype="int64")
    first = np.maximum(here - (window_size - 1), group_start)
    frames = _Frames(first=first, after=here + 1)

    def over(series: np.ndarray):
        return pd.Series(series).rolling(frames, min_periods=1)

    def in_frame(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[here + 1] - total[first]

    short = in_frame(~null) < min_periods
    finite = bool(np.isfinite(numbers).all())
    columns = {}
    if "mean" in aggs:
        mean = over(np.where(null | ~np.isfinite(numbers), np.nan, numbers)).mean().to_numpy()
        if not finite:
            plus = in_frame(~null & (numbers == np.inf)) > 0
            minus = in_frame(~null & (numbers == -np.inf)) > 0
            nan = in_frame(~null & np.isnan(numbers)) > 0
            mean = np.where(plus, np.inf, np.where(minus, -np.inf, mean))
            mean = np.where((plus & minus) | nan, np.nan, mean)
        columns["rolling_mean"] = pa.array(mean, pa.float64(), mask=short)
    if "median" in aggs:
        if finite:
            median = over(np.where(null, np.nan, numbers)).median().to_numpy()
        else:
            median = _median_by_rank(numbers, null, over)
        columns["rolling_median"] = pa.array(median, pa.float64(), mask=short)
    return columns


def _median_by_rank(numbers: np.ndarray, null: np.ndarray, over) -> np.ndarray:
    """Rolling median over the ranks of the values: finite, and NaN ranks last."""
    distinct, rank_of = np.unique(numbers[~null], return_inverse=True)
    ranks = np.full(len(numbers), np.nan)
    ranks[~null] = rank_of
    sides = []
    for side in ("lower", "higher"):
        rank = over(ranks).quantile(0.5, interpolation=side).to_numpy()
        picked = np.full(len(numbers), np.nan)
        known = ~np.isnan(rank)
        picked[known] = distinct[np.rint(rank[known]).astype("int64")]
        sides.append(picked)
    low, high = sides
    with np.errstate(invalid="ignore"):
        return np.where(low == high, low, (low + high) / 2)


def _group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    changed = np.zeros(len(table), dtype=bool)
    for name in keys:
        column = table[name].combine_chunks()
        after, before = column.slice(1), column.slice(0, len(column) - 1)
        differs = pc.not_equal(after, before)
        if column.null_count:
            differs = pc.if_else(pc.is_null(differs), pc.not_equal(pc.is_null(after), pc.is_null(before)), differs)
        changed[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.maximum.accumulate(np.where(changed, np.arange(len(table)), 0))


def rolling_batches(
    batches: Iterable[pa.RecordBatch],
    keys: list[str],
    value_col: str,
    window_size: int,
    min_periods: int,
    aggs,
    step_rows: int = 100_000,
) -> Iterator[pa.RecordBatch]:
    """Extend a stream of rows sorted by ``keys`` and time with their rolling columns.

    Only about ``step_rows`` rows and one window are held at a time, however
    long a group is: the last ``window_size - 1`` rows go along to the next step.
    """
    step_rows = max(step_rows, 4 * window_size)
    carried: pa.Table | None = None
    waiting: list[pa.RecordBatch] = []

    def advance() -> list[pa.RecordBatch]:
        nonlocal carried
        fresh = pa.Table.from_batches(waiting)
        waiting.clear()
        table = fresh if carried is None else pa.concat_tables([carried, fresh])
        starts = _group_starts(table, keys)
        values = table[value_col].combine_chunks()
        done = rolling_columns(values, starts, window_size, min_periods, aggs)
        known = len(table) - len(fresh)
        carried = table.slice(max(len(table) - (window_size - 1), int(starts[-1])))
        for name, column in done.items():
            fresh = fresh.append_column(name, column.slice(known))
        return fresh.to_batches()

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= step_rows:
            yield from advance()
    if waiting:
        yield from advance()
