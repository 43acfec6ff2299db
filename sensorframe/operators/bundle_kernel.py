"""Source, rolling and window series out of one sorted stream, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from .resample_kernel import whole_groups, windows_of
from .rolling_kernel import _group_starts, rolling_columns

# The places of the series of one table must fit 63 bits.
_AXIS = 1 << 62


def _on_one_axis(table: pa.Table, keys: list[str], more: int) -> Iterator[pa.Table]:
    """Runs of whole series whose time spans, each with ``more`` beside it, fit one axis."""
    begins = np.unique(_group_starts(table, keys))
    us = table["us"].to_numpy()
    spans = (us[np.append(begins[1:], len(us)) - 1] - us[begins]).astype(object) + more
    at, held = 0, 0
    for begin, span in zip(begins, spans):
        if held and held + span > _AXIS:
            yield table.slice(at, begin - at)
            at, held = int(begin), 0
        held += span
    yield table.slice(at)


def bundle_batches(
    batches: Iterable[pa.RecordBatch], keys: list[str], names: list[str], spec, step_rows: int = 200_000
) -> Iterator[pa.RecordBatch]:
    """From rows ``(keys, us, seq?, v)`` sorted by keys, time and tie-breaker to ``(series, keys, us, y)``.

    ``series`` is the place of the series' name in ``names``. Held at a time: about ``step_rows`` rows, or one series.
    """
    every, period = spec.every_s * 1_000_000, spec.period_s * 1_000_000

    def rows(name: str, table: pa.Table, us: str, y: pa.ChunkedArray | pa.Array) -> Iterator[pa.RecordBatch]:
        number = pa.array(np.full(len(table), names.index(name), np.int32))
        out = {"series": number} | {key: table[key] for key in keys} | {"us": table[us], "y": y}
        yield from pa.table(out).combine_chunks().to_batches()

    for table in whole_groups(batches, keys, step_rows):
        yield from rows("source", table, "us", table["v"])
        if spec.rolling:
            values = table["v"].combine_chunks()
            rolled = rolling_columns(values, _group_starts(table, keys), spec.window_size, spec.min_periods, spec.rolling)
            for name, y in rolled.items():
                yield from rows(name, table, "us", y)
        if spec.resampling:
            for part in _on_one_axis(table, keys, 2 * period + 2 * every):
                windows = windows_of(part, keys, every, period, None, spec.resampling)
                for agg in spec.resampling:
                    yield from rows(f"resampling_{agg}", windows, "start", windows[agg])
