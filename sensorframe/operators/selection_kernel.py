"""Selecting ranks in sliding windows, over sorted Arrow batches, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from .resample_kernel import whole_groups
from .rolling_kernel import _group_starts

#: What a row of the mixed streams is.
ENTRY, QUESTION = 0, 1

# Differences of running counts that are looked at together.
_CELLS = 1 << 22


def narrow(at: np.ndarray, part: np.ndarray, n: np.ndarray, parts: int, low_at: np.ndarray, high_at: np.ndarray, k: np.ndarray):
    """In which part the ``k``-th smallest value between two times lies, and which it is there.

    ``n`` values of ``part`` are at the moment ``at``, in rising order of moments.
    """
    moments, row = np.unique(at, return_inverse=True)
    upto = np.zeros((len(moments) + 1, parts), np.int64)
    np.add.at(upto, (row + 1, part), n)
    upto = upto.cumsum(axis=0)
    low, high = np.searchsorted(moments, low_at), np.searchsorted(moments, high_at)
    found, rest = np.empty(len(k), np.int64), np.empty(len(k), np.int64)
    step = max(1, _CELLS // parts)
    for begin in range(0, len(k), step):
        own = slice(begin, begin + step)
        inside = (upto[high[own]] - upto[low[own]]).cumsum(axis=1)
        found[own] = (inside <= k[own, None]).sum(axis=1)
        below = np.take_along_axis(inside, np.maximum(found[own] - 1, 0)[:, None], axis=1)[:, 0]
        rest[own] = k[own] - np.where(found[own] > 0, below, 0)
    return found, rest


def select(at: np.ndarray, rank: np.ndarray, low_at: np.ndarray, high_at: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The ``k``-th smallest of distinct ``rank`` between two times, by a wavelet matrix: one pass per bit for all questions."""
    low, high, k = np.searchsorted(at, low_at), np.searchsorted(at, high_at), k.copy()
    least = int(rank.min())
    order = rank - least
    found = np.zeros(len(k), np.int64)
    for bit in range(int(order.max()).bit_length() - 1, -1, -1):
        one = (order >> bit) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        z_low, z_high = zeros[low], zeros[high]
        up = k >= z_high - z_low
        found |= up.astype(np.int64) << bit
        k = np.where(up, k - (z_high - z_low), k)
        low = np.where(up, zeros[-1] + low - z_low, z_low)
        high = np.where(up, zeros[-1] + high - z_high, z_high)
        order = np.concatenate([order[one == 0], order[one == 1]])
    return found + least


def _groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    for table in whole_groups(batches, keys, 100_000):
        starts = np.unique(_group_starts(table, keys))
        for begin, end in zip(starts, [*starts[1:], len(table)]):
            yield table.slice(begin, end - begin)


def _split(group: pa.Table, *columns: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Entries and questions of a group, sorted in that order."""
    cut = int((group["kind"].to_numpy() == ENTRY).sum())
    numbers = [group[c].to_numpy() for c in columns]
    return [x[:cut] for x in numbers], [x[cut:] for x in numbers]


def _with_keys(group: pa.Table, keys: list[str], columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    same = {key: group[key].take(pa.array(np.zeros(n, np.int64))) for key in keys}
    yield from pa.table(same | {c: pa.array(x) for c, x in columns.items()}).combine_chunks().to_batches()


def narrow_batches(batches: Iterable[pa.RecordBatch], keys: list[str], parts: int, period: int) -> Iterator[pa.RecordBatch]:
    """From ``(keys, bin, kind, at, x, n)`` sorted by keys, bin, kind and time to ``(keys, bin, start, k)`` one level down.

    An entry tells that ``n`` values of the finer bin ``x`` are at a moment; a question asks for the ``x``-th smallest
    from ``at`` on for a period. Held at a time: one bin's entries.
    """
    for group in _groups(batches, [*keys, "bin"]):
        (at, x, n), (start, k, _) = _split(group, "at", "x", "n")
        if len(k):
            first = int(group["bin"][0].as_py()) * parts
            found, rest = narrow(at, x - first, n, parts, start, start + period, k)
            yield from _with_keys(group, keys, {"bin": found + first, "start": start, "k": rest})


def select_batches(batches: Iterable[pa.RecordBatch], keys: list[str], period: int) -> Iterator[pa.RecordBatch]:
    """From ``(keys, bin, kind, at, x, v)`` sorted likewise, entries being values ``v`` of rank ``x``, to ``(keys, start, v)``."""
    for group in _groups(batches, [*keys, "bin"]):
        (at, rank, v), (start, k, _) = _split(group, "at", "x", "v")
        if len(k):
            by_rank = np.argsort(rank)
            place = np.searchsorted(rank[by_rank], select(at, rank, start, start + period, k))
            yield from _with_keys(group, keys, {"start": start, "v": v[by_rank[place]]})
