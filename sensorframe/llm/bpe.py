"""Byte-level BPE: encoding by a pair occurrence index, and decoding.

Texts are cut into chunks that no merge crosses. The distinct chunks that a slab of a partition brings for the first
time are split by the tokenizer's pattern, laid out as one array of symbols, and merged together: an index maps every
mergeable pair to all its positions, active ranks are applied in ascending order, each to all positions of its pair at
once, and only the lists of the pairs beside a merge change. Chunks already merged by the task are looked up.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batch_of, id_and_body

#: Characters with Unicode's White_Space property.
_SPACE = "\t-\r \x85\xa0  -     　"
#: The published split pattern of byte-level vocabularies, with white space spelled out.
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Runs of text with the space before them; white space that stands alone.
CHUNK = rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]"
_ODD = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c")

#: Bytes of text whose new chunks are merged together, and chunks that a task remembers.
SLAB_BYTES = 8 << 20
CACHE_CHUNKS = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeTables:
    """Merge ranks, token bytes and special tokens of a byte-level tokenizer file; a few MB, whatever the data."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.size = 1 + max(vocab.values())
        self.byte_ids = [0] * 256
        self.token_bytes: dict[int, bytes] = {}
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
            if len(token) == 1:
                self.byte_ids[alphabet[token]] = i
        self.ranks: dict[int, int] = {}  # left id * size + right id -> rank
        self.merged: list[tuple[int, int, int]] = []  # by rank
        made = {i: -1 for i in self.byte_ids}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            if not (made.get(a, rank) < rank and made.get(b, rank) < rank) or c in made:
                raise ValueError("merges must be listed after those that make their parts, one for each token")
            made[c] = rank
            self.ranks[a * self.size + b] = rank
            self.merged.append((a, b, c))
        self.pair_keys = np.array(sorted(self.ranks), np.int64)
        self.pair_ranks = np.array([self.ranks[k] for k in self.pair_keys.tolist()], np.int64)
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes |= {i: content for content, i in self.special.items()}


def merge_words(words: list[bytes], tables: BpeTables) -> list[list[int]]:
    """Ids of each word. All words are merged together, rank by rank, over an index from pairs to positions."""
    size, ranks = tables.size, tables.ranks
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    flat = np.array(tables.byte_ids, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
    links = np.arange(1, len(flat) + 1)
    links[ends - 1] = -1
    after = links.tolist()
    links = np.arange(-1, len(flat) - 1)
    links[ends - lengths] = -1
    before = links.tolist()
    symbol = flat.tolist()
    # The index over the first layout: positions grouped by the rank of the pair that begins there.
    pairs = flat[:-1] * size + flat[1:]
    pairs[ends[:-1] - 1] = -1
    slot = np.searchsorted(tables.pair_keys, pairs).clip(max=len(tables.pair_keys) - 1)
    places = np.flatnonzero(tables.pair_keys[slot] == pairs)
    found = tables.pair_ranks[slot[places]]
    places = places[np.argsort(found, kind="stable")]
    present, counts = np.unique(found, return_counts=True)
    where = {r: p.tolist() for r, p in zip(present.tolist(), np.split(places, np.cumsum(counts)[:-1]))}
    find = ranks.get
    active = list(where)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        a, b, c = tables.merged[rank]
        c_size = c * size
        # Every list is ascending where its order matters: a pair of equal symbols comes from the first layout or from one earlier merge.
        for p in sorted(where.pop(rank)) if a == b else where.pop(rank):
            if symbol[p] != a or (q := after[p]) < 0 or symbol[q] != b:
                continue
            symbol[p], symbol[q] = c, -1
            r = after[p] = after[q]
            if r >= 0:
                before[r] = p
                if (new := find(c_size + symbol[r])) is not None:
                    if new in where:
                        where[new].append(p)
                    else:
                        where[new] = [p]
                        heapq.heappush(active, new)
            if (o := before[p]) >= 0 and (new := find(symbol[o] * size + c)) is not None:
                if new in where:
                    where[new].append(o)
                else:
                    where[new] = [o]
                    heapq.heappush(active, new)
    out, at = [], 0
    for word in words:
        end = at + len(word)
        out.append([s for s in symbol[at:end] if s >= 0])
        at = end
    return out


class PairIndexEncoder:
    """Chunks to ids: the pretokens of all chunks given that the task has not met yet go through one index."""

    def __init__(self, tables: BpeTables) -> None:
        self.tables, self.pattern = tables, regex.compile(PRETOKEN)
        self.words: dict[str, bytes] = {}

    def __call__(self, chunks: list[bytes]) -> list[bytes]:
        if len(self.words) > CACHE_CHUNKS:
            self.words.clear()
        split = [self.pattern.findall(c.decode("utf-8", "replace")) for c in chunks]
        new = list({w for parts in split for w in parts}.difference(self.words))
        if new:
            merged = merge_words([w.encode("utf-8", "surrogatepass") for w in new], self.tables)
            self.words.update((w, array("I", i).tobytes()) for w, i in zip(new, merged))
        return [b"".join(map(self.words.__getitem__, parts)) for parts in split]


class ChunkCache:
    """Texts to ids (little-endian unsigned 32-bit), each distinct chunk encoded once while the cache remembers it.

    A key is a run of text without spaces. It stands for itself after one space; after a line feed, which it then
    begins with; or, behind a space of its own, for exactly the bytes that follow.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]], special: dict[bytes, int]) -> None:
        self.encode, self.special = encode, special
        self.cache: dict[bytes, bytes | None] = {}
        self.chunk = regex.compile(CHUNK)
        self.specials = re.compile(b"(" + b"|".join(map(re.escape, special)) + b")") if special else None

    def keys(self, text: bytes) -> list[bytes]:
        if not text:
            return []
        if text[0] not in b" \n" and text[-1] not in b" \n" and not any(odd in text for odd in _ODD):
            first, *rest = text.replace(b"\n", b" \n").split(b" ")
            return [b" " + first, *rest]
        return self.plain_keys(text)

    def plain_keys(self, text: bytes) -> list[bytes]:
        keys = []
        for c in self.chunk.findall(text.decode("utf-8", "replace")):
            c = c.encode("utf-8", "surrogatepass")
            keys.append(c[1:] if len(c) > 1 and c[:1] == b" " and c[1:2] not in b" \n" else b" " + c)
        return keys

    def learn(self, keys: Iterable[bytes]) -> None:
        """Encode keys that are new. A key with white space at an edge, where it may belong to a longer run, gets None."""
        good = []
        for key in keys:
            inner = key[1:] if key[:1] in b" \n" else key
            edge = inner.decode("utf-8", "replace")
            if key[:1] != b" " and (not edge or edge != edge.strip()):
                self.cache[key] = None
            else:
                good.append(key)
        chunks = [k[1:] if k[:1] == b" " else k if k[:1] == b"\n" else b" " + k for k in good]
        self.cache.update(zip(good, self.encode(chunks)))

    def one(self, text: bytes) -> bytes:
        found = list(map(self.cache.get, self.keys(text)))
        if None in found:
            keys = self.plain_keys(text)
            self.learn_plain(keys)
            found = list(map(self.cache.get, keys))
        return b"".join(found)

    def learn_plain(self, keys: list[bytes]) -> None:
        new = [k for k in dict.fromkeys(keys) if self.cache.get(k) is None]
        chunks = [k[1:] if k[:1] == b" " else b" " + k for k in new]
        self.cache.update(zip(new, self.encode(chunks)))

    def parts(self, text: bytes) -> list[bytes]:
        return self.specials.split(text) if self.specials and any(s in text for s in self.special) else [text]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        split = [self.parts(t) for t in texts]
        new: set[bytes] = set()
        for parts in split:
            for part in parts[::2]:
                new |= set(self.keys(part)).difference(self.cache)
        self.learn(new)
        ids = {s: array("I", [i]).tobytes() for s, i in self.special.items()}
        return [b"".join(ids[p] if i % 2 else self.one(p) for i, p in enumerate(parts)) for parts in split]


def slabs(batches: Iterator[pa.RecordBatch], limit: int = SLAB_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts, about ``limit`` bytes of text at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(text)
            size += len(text)
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def decode_ids(ids: Iterable[int], tables: BpeTables) -> str:
    """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(tables.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_documents(
    docs: DataFrame, tables: BpeTables, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns one row per document: ``doc_id, ids`` (little-endian unsigned 32-bit) ``, decoded``; with ``digests``
    instead ``doc_id, n_tokens, ids_sha256, decoded_sha256``. Null and empty texts have no ids; strings of special
    tokens inside a text get their id, as the library does by default. Repeated rows and null ids are returned as they
    come; an empty table gives none; other columns are not read. There is no shuffle. A task holds one slab of texts
    (or one longer text) and a bounded cache.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkCache(PairIndexEncoder(tables), tables.special)
        decimal = {i: str(i).encode() for i in tables.token_bytes}
        for doc_ids, texts in slabs(batches):
            rows = []
            for doc_id, ids in zip(doc_ids, cache.encode_all(texts)):
                numbers = np.frombuffer(ids, "<u4").tolist()
                decoded = decode_ids(numbers, tables)
                if digests:
                    joined = b",".join(map(decimal.__getitem__, numbers))
                    rows.append((doc_id, len(numbers), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                else:
                    rows.append((doc_id, ids, decoded))
            yield batch_of(_DIGEST if digests else _SCHEMA, zip(*rows))

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids binary, decoded string"
    return id_and_body(docs, id_col, text_col).mapInArrow(run, kind)
