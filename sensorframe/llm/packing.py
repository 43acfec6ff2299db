"""Best-fit packing of documents into sequences of a fixed number of tokens.

Best-fit decreasing, planned on the driver over the histogram of lengths, which the capacity bounds whatever the number
of documents: longest first, the pieces of a length take the gaps from the tightest that holds them upwards, a gap whose
piece left room goes back under its new size, and pieces without a gap open new sequences. Pieces of one length are
alike, so whole runs of ranks move at once. Spark ranks the pieces by length through range partitions and distributed
offsets, and rows find their place in the plan by length and rank. Successor sweeps over gap tables in rounds would be
the distributed form; this is the same packing with the gaps held as a histogram.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import pin
from .bpe import BpeTables, slabs
from .common import batch_of, id_and_body, rank_in_groups

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
_PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Characters of a text that go through the tokenizer at once, up to the next single space between words.
STRETCH = 1 << 20


class RankFileEncoder:
    """Texts to ids (little-endian unsigned 32-bit) through the byte-pair merges of the tables, by tiktoken.

    The pattern looks ahead only to leave a run of white space its last character. Where no two white space characters
    meet, the same pattern without looking ahead cuts alike, and much faster.
    """

    def __init__(self, tables: BpeTables, pattern: str) -> None:
        special = set(tables.special.values())
        ranks = {token: i for i, token in tables.token_bytes.items() if i not in special}
        # Ids of byte-level vocabularies need not be in merge order, while tiktoken merges by rank: map ranks to ids.
        order = {tables.byte_ids[b]: -256 + b for b in range(256)} | {c: r for r, (_, _, c) in enumerate(tables.merged)}
        by_rank = sorted(ranks.items(), key=lambda t: order[t[1]])
        self.ids = np.array([i for _, i in by_rank], "<u4")
        self.ranks = {t: r for r, (t, _) in enumerate(by_rank)}
        self.pattern, self.codings = pattern, {}
        self.run, self.gap = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")
        self.special = {s: np.array([i], "<u4").tobytes() for s, i in tables.special.items()}
        self.specials = re.compile(b"(" + b"|".join(map(re.escape, self.special)) + b")") if self.special else None

    def coding(self, pattern: str):
        import tiktoken

        if pattern not in self.codings:
            self.codings[pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        return self.codings[pattern]

    def encode(self, text: bytes) -> bytes:
        if not any(s in text for s in self.special):
            return self.plain(text)
        parts = self.specials.split(text)
        return b"".join(self.special[p] if i % 2 else self.plain(p) for i, p in enumerate(parts))

    def plain(self, text: bytes) -> bytes:
        chars, out, at = text.decode("utf-8", "replace"), [], 0
        while at < len(chars):
            cut = self.gap.search(chars, at + STRETCH) if len(chars) - at > STRETCH else None
            end = cut.start() if cut else len(chars)
            stretch = chars[at:end]
            pattern = self.pattern if self.run.search(stretch) else self.pattern.replace(r"\s+(?!\S)|\s+", r"\s")
            ranks = array("I", self.coding(pattern).encode_ordinary(stretch))
            out.append(self.ids[np.frombuffer(ranks, np.uint32)].tobytes())
            at = end
        return b"".join(out)


def pieces_of(
    docs: DataFrame, tables: BpeTables, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and ``end_id``, cut only if longer than the capacity.

    Pieces of a cut document hold ``capacity`` ids; only the first may be shorter.
    """
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = RankFileEncoder(tables, pattern)
        for doc_ids, texts in slabs(batches):
            rows = []
            for doc_id, text in zip(doc_ids, texts):
                ids = encoder.encode(text) + end
                start, n = 0, len(ids) // 4
                cut = n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    part = memoryview(ids)[4 * start : 4 * cut]
                    rows.append((doc_id, piece, start, cut - start, zlib.crc32(part)))
                    start, cut = cut, cut + capacity
            yield batch_of(_PIECES, zip(*rows))

    return id_and_body(docs, id_col, text_col).mapInArrow(run, _PIECES_SQL)


class Gaps:
    """Open sequences by the room they leave: for each size the runs of neighbouring sequences, oldest first."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.runs: dict[int, deque[tuple[int, int]]] = {}

    def put(self, size: int, first: int, n: int) -> None:
        if size:
            if size not in self.runs:
                bisect.insort(self.sizes, size)
                self.runs[size] = deque()
            self.runs[size].append((first, n))

    def take(self, size: int, most: int) -> tuple[int, int]:
        runs = self.runs[size]
        first, n = runs.popleft()
        if n > most:
            runs.appendleft((first + most, n - most))
            n = most
        if not runs:
            del self.runs[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))
        return first, n


def best_fit(histogram: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length, runs of ranks: (first rank, first sequence, first sequence's step per rank as pieces per sequence, offset).

    A run (rank, sequence, per, offset) places rank + k in sequence + k // per at offset + (k % per) * length.
    """
    gaps, opened, plan = Gaps(), 0, {}
    for length in sorted(histogram, reverse=True):
        left, rank, runs = histogram[length], 0, []
        while left:
            i = bisect.bisect_left(gaps.sizes, length)
            if i == len(gaps.sizes):
                break
            size = gaps.sizes[i]
            per = size // length
            first, n = gaps.take(size, max(1, left // per))
            per = min(per, left // n)
            runs.append((rank, first, per, capacity - size))
            gaps.put(size - per * length, first, n)
            rank, left = rank + n * per, left - n * per
        per = capacity // length
        for n, each in ((left // per, per), (1, left % per)):
            if n and each:
                runs.append((rank, opened, each, 0))
                gaps.put(capacity - each * length, opened, n)
                rank, opened = rank + n * each, opened + n
        plan[length] = runs
    return plan


def pack_documents(
    docs: DataFrame,
    tables: BpeTables,
    pattern: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece that holds only ``end_id``. Repeated rows are packed one by one, null ids too;
    documents of equal length are interchangeable, so ties change which sequence holds a document, never the number of
    sequences. An empty table gives an empty result; other columns are not read.
    """
    # written first: the range partitioning samples its input, which must not encode everything once more
    pieces = pin(pieces_of(docs, tables, pattern, capacity, end_id, id_col, text_col), "pieces")
    ranked = rank_in_groups(pieces, ["length"], ["doc_id", "piece"], "ranked-by-length")
    ranked = pin(ranked, "ranked-pieces")
    # One count per length: at most ``capacity`` rows.
    histogram = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = {length: tuple(np.array(c, np.int64) for c in zip(*runs)) for length, runs in best_fit(histogram, capacity).items()}
    schema = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                first, opened, per, begin = plan[int(one)]
                run = np.searchsorted(first, rank[at], "right") - 1
                k = rank[at] - first[run]
                sequence[at] = opened[run] + k // per[run]
                offset[at] = begin[run] + k % per[run] * one
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema=schema)

    return ranked.mapInArrow(place, f"{_PIECES_SQL}, sequence_id long, offset long")
