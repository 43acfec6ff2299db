"""Window means and exact medians over sorted Arrow batches, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from .rolling_kernel import _Frames, _group_starts, _median_by_rank


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], step_rows: int) -> Iterator[pa.Table]:
    """Cut a stream sorted by ``keys`` into tables of whole groups: about ``step_rows`` rows, or one longer group, at a time."""
    waiting: list[pa.RecordBatch] = []
    held, next_step = 0, step_rows
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            held += batch.num_rows
        if held >= next_step:
            table = pa.Table.from_batches(waiting)
            cut = int(_group_starts(table, keys)[-1])
            if cut:
                yield table.slice(0, cut)
            waiting, held = table.slice(cut).to_batches(), len(table) - cut
            next_step = max(step_rows, 2 * held)  # one long group is not looked through again for every batch
    if held:
        yield pa.Table.from_batches(waiting)


def _slot_sums(values: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, period: int):
    """Sum of ``values[low:high]`` of every window, by the sums of slots as long as a window.

    A window meets two slots: the end of one and the beginning of the next. Running sums from either side of a slot
    only ever add, so no value that has left a window can leave a trace, and a window costs two lookups.
    """
    slot = pd.Series(at // period)
    series = pd.Series(values)
    upto = series.groupby(slot, sort=False).cumsum().to_numpy()
    onward = series[::-1].groupby(slot[::-1], sort=False).cumsum().to_numpy()[::-1]
    middle = np.searchsorted(at, (start // period + 1) * period)
    middle = np.clip(middle, low, high)
    last = len(values) - 1
    left = np.where(middle > low, onward[np.minimum(low, last)], 0.0)
    return left + np.where(high > middle, upto[np.clip(high - 1, 0, last)], 0.0)


def _slot_means(values: np.ndarray, counts, at: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, period: int):
    """Mean of every window from sums of ``counts`` values each (``None``: one each); infinities and NaN, which running
    sums would not let go, are counted and put back."""
    finite = np.isfinite(values)
    n = high - low if counts is None else _spans(counts, low, high)
    mean = _slot_sums(np.where(finite, values, 0.0), at, low, high, start, period) / np.maximum(n, 1)
    if finite.all():
        return mean
    plus, minus = (_spans(values == odd, low, high) > 0 for odd in (np.inf, -np.inf))
    mean = np.where(plus, np.inf, np.where(minus, -np.inf, mean))
    return np.where((plus & minus) | (_spans(np.isnan(values), low, high) > 0), np.nan, mean)


def _spans(numbers: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of whole ``numbers[low:high]``."""
    total = np.concatenate([[0], np.cumsum(numbers)])
    return total[high] - total[low]


def _frame_medians(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Median of ``values[low:high]`` of every window; bounds never go back, so values enter and leave once."""
    size = max(len(values), len(low))
    padded = np.concatenate([values, np.full(size - len(values), np.nan)])
    more = size - len(low)
    # Padding repeats the last bounds: were they to fall, every frame would be built from nothing.
    frames = _Frames(first=np.pad(low, (0, more), "edge"), after=np.pad(high, (0, more), "edge"))
    over = lambda series: pd.Series(series).rolling(frames, min_periods=1)
    if np.isfinite(values).all():
        return over(padded).median().to_numpy()[: len(low)]
    null = np.arange(size) >= len(values)
    return _median_by_rank(np.where(null, 0.0, padded), null, over)[: len(low)]


def windows_of(table: pa.Table, keys: list[str], every: int, period: int, block: int | None, aggs) -> pa.Table:
    """All windows with a row, of whole groups sorted by time: groups are ``(keys, block)``, or whole series without ``block``.

    A whole series has no window before its first row's pane.
    """
    group_start = _group_starts(table, [*keys, "block"] if block else keys)
    begins = np.flatnonzero(group_start == np.arange(len(table)))
    group = np.searchsorted(begins, group_start)
    us = table["us"].to_numpy()
    first, last = us[begins], us[np.append(begins[1:], len(us)) - 1]
    home_of = table["block"].to_numpy()[begins] if block else first - first % every
    # Every group gets a stretch of one common axis to itself.
    stretch = 2 * period + every + (np.full(len(begins), block) if block else last - home_of)
    base = np.cumsum(stretch) - stretch + period
    home, base = home_of[group], base[group]
    place = us - home + base
    oldest = np.maximum(-(-(us - home - period + 1) // every), 0)
    newest = (us - home) // every
    if block:
        newest = np.minimum(newest, block // every - 1)
    if "opens" in table.column_names:
        # Where a group holds its series' first row, no window starts before that row's pane.
        opens = np.logical_or.reduceat(table["opens"].to_numpy(), begins)
        oldest = np.maximum(oldest, np.where(opens, (first - home_of) // every, 0)[group])
    # Times rise, so a row adds the windows after its predecessor's newest.
    before = np.concatenate([[-1], newest[:-1]])
    before[begins] = -1
    fresh_from = np.maximum(oldest, before + 1)
    fresh = np.maximum(newest - fresh_from + 1, 0)
    row = np.repeat(np.arange(len(us)), fresh)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(fresh) - fresh, fresh)
    offset = (fresh_from[row] + nth) * every
    start = offset + base[row]
    low, high = np.searchsorted(place, start), np.searchsorted(place, start + period)
    out = {key: table[key].take(pa.array(row)) for key in keys}
    out |= {"start": pa.array(home[row] + offset)}
    column = table["v"].combine_chunks()
    known = column.is_valid().to_numpy(zero_copy_only=False)
    values = column.drop_null().to_numpy(zero_copy_only=False)
    counts = table["n"].to_numpy()[known] if "n" in table.column_names else None
    counted = np.concatenate([[0], np.cumsum(known)])
    low, high = counted[low], counted[high]
    empty = high == low
    for agg in aggs:
        if not len(values) or not len(low):
            result = np.full(len(low), np.nan)
        elif agg == "mean":
            result = _slot_means(values, counts, place[known], low, high, start, period)
        elif agg == "n":
            result = _spans(np.ones(len(values), int) if counts is None else counts, low, high)
        else:
            result = _frame_medians(values, low, high)
        out[agg] = pa.array(result.astype(np.int64)) if agg == "n" else pa.array(result, pa.float64(), mask=empty)
    return pa.table(out)


def window_batches(
    batches: Iterable[pa.RecordBatch], keys: list[str], every: int, period: int, block: int, aggs, step_rows: int = 200_000
) -> Iterator[pa.RecordBatch]:
    """From rows ``(keys, block, us, v, n?, opens?)`` sorted by keys, block and time to ``(keys, start, mean?, median?, n?)``.

    With ``n`` a row stands for so many values of one pane and ``v`` is their sum. ``opens`` marks a series' first row,
    before whose pane no window starts. Work is linear in rows plus windows. Held at a time: about ``step_rows`` rows or
    one block.
    """
    # places on the common axis must fit 63 bits
    step_rows = max(1, min(step_rows, (1 << 62) // (block + 2 * period + every)))
    for table in whole_groups(batches, [*keys, "block"], step_rows):
        yield from windows_of(table, keys, every, period, block, aggs).combine_chunks().to_batches()
