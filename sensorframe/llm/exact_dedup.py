"""Exact duplicates by Patricia-trie owners.

Texts go to partitions by their length and a hash of their content. In a partition their whole byte strings are put into
a compressed radix trie, whose terminal nodes hold the owner (smallest or largest id) and the number of members, so two
texts meet only if every byte is equal. A trie past its memory budget spills its largest subtrees to files of the task,
which are built one by one afterwards. The same trie runs once before the shuffle, so of a text that a third of all rows
share, each input task sends one row.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import batch_of

#: Bytes of keys and nodes that one trie holds before it spills.
TRIE_BYTES = 96 << 20
_NODE_BYTES = 200
_RECORD, _RECORD_BYTES = "<IqBq", struct.calcsize("<IqBq")


class Spilled:
    """A subtree on disk: records of what its keys still lack, in a file that ends with the task."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()

    def add(self, rest: bytes, owner: int | None, members: int) -> None:
        self.file.write(struct.pack(_RECORD, len(rest), owner or 0, owner is not None, members))
        self.file.write(rest)

    def records(self) -> Iterator[tuple[bytes, int | None, int]]:
        self.file.seek(0)
        while head := self.file.read(_RECORD_BYTES):
            size, owner, known, members = struct.unpack(_RECORD, head)
            yield self.file.read(size), owner if known else None, members
        self.file.close()


class RadixTrie:
    """Byte strings to (owner, members). A node is [label, children by first byte, owner, members]; members is 0 where no key ends."""

    def __init__(self, better: Callable[[int, int], int], limit: int = TRIE_BYTES) -> None:
        self.better, self.limit = better, limit
        self.root: list = [b"", {}, None, 0]
        self.held = 0

    def insert(self, key: bytes, owner: int | None, members: int) -> None:
        node, at, end = self.root, 0, len(key)
        while at < end:
            children = node[1]
            child = children.get(key[at])
            if child is None:
                child = children[key[at]] = [key[at:], {}, None, 0]
                self.held += end - at + _NODE_BYTES
                node = child
                break
            if isinstance(child, Spilled):
                child.add(key[at:], owner, members)
                return
            label = child[0]
            if not key.startswith(label, at):
                same = common_length(label, key, at)
                child[0] = label[same:]
                children[key[at]] = [label[:same], {label[same]: child}, None, 0]
                self.held += _NODE_BYTES
                child = children[key[at]]
            at += len(child[0])
            node = child
        if owner is not None:
            node[2] = owner if node[2] is None else self.better(node[2], owner)
        node[3] += members

    def items(self, prefix: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        """All keys, first those in memory, then each spilled subtree by a trie of its own; empties the trie."""
        later: list[tuple[bytes, Spilled]] = []
        stack = [(prefix, self.root)]
        while stack:
            above, node = stack.pop()
            key = above + node[0]
            if node[3]:
                yield key, node[2], node[3]
            for child in node[1].values():
                if isinstance(child, Spilled):
                    later.append((key, child))
                else:
                    stack.append((key, child))
        self.root, self.held = [b"", {}, None, 0], 0
        for key, spilled in later:
            part = RadixTrie(self.better, self.limit)
            for rest, owner, members in spilled.records():
                part.insert(rest, owner, members)
                part.spill_if_full()
            yield from part.items(key)

    def spill_if_full(self) -> None:
        """Move the largest subtrees to disk until half the budget is free.

        They are taken where no single child holds most of the trie any more, so a subtree built again is at most half
        as heavy, and building nests a few times at most. A trie of one path, such as one very long text, has no subtree
        to give away.
        """
        if self.held <= self.limit:
            return
        top = self.root
        while True:
            sizes = {first: weight(child) for first, child in top[1].items() if not isinstance(child, Spilled)}
            heaviest = max(sizes, key=sizes.get, default=None)
            if heaviest is None or not (2 * sizes[heaviest] > self.held or len(top[1]) == 1) or not top[1][heaviest][1]:
                break
            top = top[1][heaviest]
        if len(top[1]) < 2:
            return
        for first in sorted(sizes, key=sizes.get, reverse=True):
            child, spilled = top[1][first], Spilled()
            stack = [(b"", child)]
            while stack:
                above, node = stack.pop()
                rest = above + node[0]
                if node[3]:
                    spilled.add(rest, node[2], node[3])
                for below in node[1].values():
                    if isinstance(below, Spilled):
                        for more, owner, members in below.records():
                            spilled.add(rest + more, owner, members)
                    else:
                        stack.append((rest, below))
            top[1][first] = spilled
            self.held -= sizes[first]
            if self.held <= self.limit // 2:
                break


def weight(node: list) -> int:
    total, stack = 0, [node]
    while stack:
        node = stack.pop()
        total += len(node[0]) + _NODE_BYTES
        stack += [c for c in node[1].values() if not isinstance(c, Spilled)]
    return total


def common_length(label: bytes, key: bytes, at: int) -> int:
    low, high = 1, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


_PARTIAL = pa.schema([("body", pa.binary()), ("owner", pa.int64()), ("members", pa.int64())])
_CLASS = pa.schema([("text_sha256", pa.string()), ("n_bytes", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_CLASS_SQL = "text_sha256 string, n_bytes long, keep_id long, group_size long"


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalize: Callable[[Column], Column] | None = None,
    trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if all bytes are equal after ``normalize`` (a column function; none by default). ``keep`` names
    which id of a group stays, ``smallest`` or ``largest``. Null and empty texts are one group; null ids count as
    members but own a group only if it has no other id (``keep_id`` is then null, and its rows stay). Rows repeated
    with one id are one document: they stay or go alike. An empty table gives an empty result; other columns are not
    read, whatever their names.
    """
    better = {"smallest": min, "largest": max}[keep]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (normalize(text) if normalize else text).cast("binary").alias("body")
    )

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(better, trie_bytes)

        def flush() -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for key, owner, members in trie.items():
                rows.append((key, owner, members))
                size += len(key)
                if size > 8 << 20:
                    yield batch_of(_PARTIAL, zip(*rows))
                    rows, size = [], 0
            if rows:
                yield batch_of(_PARTIAL, zip(*rows))

        for batch in batches:
            for key, owner in zip(batch.column("body").to_pylist(), batch.column("owner").to_pylist()):
                trie.insert(key, owner, 1)
                if trie.held > trie.limit:
                    yield from flush()
        yield from flush()

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(better, trie_bytes)
        for batch in batches:
            for key, owner, members in zip(*(batch.column(c).to_pylist() for c in ("body", "owner", "members"))):
                trie.insert(key, owner, members)
                trie.spill_if_full()
        rows = []
        for key, owner, members in trie.items():
            rows.append((hashlib.sha256(key).hexdigest(), len(key), owner, members))
            if len(rows) == 10_000:
                yield batch_of(_CLASS, zip(*rows))
                rows = []
        if rows:
            yield batch_of(_CLASS, zip(*rows))

    distinct = rows.select("body", F.col("doc_id").alias("owner")).mapInArrow(combine, "body binary, owner long, members long")
    distinct = distinct.withColumns({"n_bytes": F.octet_length("body"), "content_hash": F.xxhash64("body")})
    classes = distinct.repartition("n_bytes", "content_hash").select("body", "owner", "members").mapInArrow(owners, _CLASS_SQL)
    named = rows.select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("text_sha256"))
    return named.join(classes, ["n_bytes", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
