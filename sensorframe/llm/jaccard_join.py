"""Exact n-gram Jaccard join by universe partitions and the pigeonhole principle.

Sets of word shingles with J(x, y) >= t differ in few elements: |x ^ y| <= H. Elements are hashed into segments, whose
number grows with the size band of the set, so that sets over H apart in every way of spending H + 1 "units" on segments
cannot be similar: a segment whose subset of x equals that of y costs one unit, one that may also differ by one element
(the one-deletion neighbourhood) costs two. Every set is indexed by the subsets of its non-empty segments in its own
band, and in some segments by all subsets that lack one element. As a probe it asks in its own band and in the bands of
smaller partners, and spends its units where they are cheapest: the units it can spare go to the signatures that most
sets share (measured after the shuffle). A probe with too few non-empty segments in a band is taken by an exact fallback,
a prefix probe on single shingles.

Equal sets are one class from the start. Pairs are verified on whole texts. Large groups of near copies do not become
all pairs: signatures first link their members to one leader, links make components, and only signatures that still hold
several components are compared across these, by parity sketches first, so that texts which share much but not enough
do not become pairs either; each probe's nearest pair first, then all that may still link two components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.resample_kernel import whole_groups
from ..operators.rolling_kernel import _group_starts
from ..scratch import pin
from .common import batch_of, components, id_and_body

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Signatures that a task compares before it sends them on.
BUFFER_SIGNATURES = 1 << 20
#: Shingles for each part in which signatures meet: about as many signatures as a task compares at once.
PART_SHINGLES = 3 << 19
#: Bytes of text, and texts, whose shingles a task hashes and signs together: arrays that stay in the processor's cache.
STRETCH, STRETCH_TEXTS = 1 << 19, 1000
#: A word up to this many bytes has a polynomial of its bytes as hash, found from prefix sums over a run of text.
LONG_WORD, RUN = 64, 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x + _MIX[0]).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1)


_BYTES = odd_numbers(256, 1 << 20)
_BASE = int(odd_numbers(1, 2 << 20)[0])
_POWERS = np.cumprod(np.full(RUN, _BASE, np.uint64))
_INVERSE = np.cumprod(np.full(RUN, pow(_BASE, -1, 1 << 64), np.uint64))


def plain(text: bytes) -> bytes:
    """The words between ASCII white space, A-Z lower-cased, with one space between them."""
    text = text.translate(_LOWER).strip(b" ")
    return b" ".join(text.split()) if b"  " in text else text


def shingle_set(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(n)))) if len(words) >= n else {tuple(words)}


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of words that each end with one space."""
    out, at = [np.zeros(0, np.uint64)], 0
    while at < len(text):
        end = text.rfind(b" ", at, at + RUN) + 1
        if not end:  # a word longer than a run
            end = text.index(b" ", at) + 1
            out.append(np.array([xxhash.xxh64_intdigest(text[at : end - 1])], np.uint64))
            at = end
            continue
        data = np.frombuffer(text, np.uint8, end - at, at)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * _POWERS[: len(data)], out=sums[1:])
        ends = np.flatnonzero(data == 32)
        begins = np.concatenate([[0], ends[:-1] + 1])
        hashes = mix((sums[ends] - sums[begins]) * _INVERSE[begins])
        for i in np.flatnonzero(ends - begins > LONG_WORD):
            hashes[i] = xxhash.xxh64_intdigest(text[at + begins[i] : at + ends[i]])
        out.append(hashes)
        at = end
    return np.concatenate(out)


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of texts that ``plain`` gave, none of them empty, and the size of each set.

    The hashes stand text by text, sorted within each; they pick candidates, never decide a link.
    """
    words = np.array([t.count(b" ") + 1 for t in texts], np.int64)
    h = word_hashes(b" ".join([*texts, b""]))
    ends = np.cumsum(words)
    begins, factors = ends - words, odd_numbers(n, 3 << 20)
    sums, valid = np.zeros(len(h), np.uint64), np.ones(len(h), bool)
    full = max(0, len(h) - n + 1)
    for i in range(n):
        sums[:full] += h[i : full + i] * factors[i]
    for back in range(1, n):
        valid[np.maximum(ends - back, 0)] = False
    for few in range(1, n):
        at = begins[words == few]
        valid[at] = True
        sums[at] = sum((h[at + i] * factors[i] for i in range(few)), start=odd_numbers(1, few))
    hashes = mix(sums[valid])
    size = np.where(words < n, 1, words - n + 1)
    first = np.cumsum(size) - size
    for begin, end in zip(first.tolist(), (first + size).tolist()):
        hashes[begin:end].sort()
    distinct = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    distinct[first] = True
    return hashes[distinct], np.add.reduceat(distinct, first, dtype=np.int64)


def stretches(texts: list[bytes]) -> Iterator[slice]:
    """Neighbouring texts that are worked on together."""
    begin = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= STRETCH or i + 1 - begin == STRETCH_TEXTS:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


class Bands:
    """Size bands and their segments for a threshold of ``num`` / 100."""

    def __init__(self, num: int = 80) -> None:
        self.num = num
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, self.starts[-1] * 100 // num))

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def difference(self, x: int, y: int) -> int:
        """The most elements in which sets of these sizes can differ and be linked; -1 if sizes alone forbid it."""
        shared = -(-self.num * (x + y) // (100 + self.num))
        return -1 if shared > min(x, y) else x + y - 2 * shared

    def units(self, size: int, band: int) -> int:
        """H + 1 for a probe of ``size`` against all partners of ``band`` that are no larger than it; 0 if there are none."""
        low, high = self.starts[band], min(size, self.starts[band + 1] - 1)
        low = max(low, -(-size * self.num // 100))
        if low > high:
            return 0
        return 1 + max(self.difference(size, high), self.difference(size, max(low, high - 1)))

    def probes(self, size: int) -> list[int]:
        """Bands that hold partners no larger than ``size``."""
        return [b for b in range(self.band(-(-size * self.num // 100)), self.band(size) + 1) if self.units(size, b)]

    def segments(self, band: int) -> tuple[int, int]:
        """(segments, how many of them have one-deletion neighbourhoods).

        Small sets leave segments empty by chance, so they get neighbourhoods everywhere; larger ones get spare segments
        and a few neighbourhoods for what chance and frequent signatures take away.
        """
        high = self.starts[band + 1] - 1
        need = max(self.units(x, band) for x in range(high, min(high * 100 // self.num, high + 12) + 1))
        need = max(need, 1 + (high + high * 100 // self.num) * (100 - self.num) // (100 + self.num) if high > 12 else 0)
        if need <= 2:
            return 1, 1
        if need <= 16:
            return need + 5, need + 5
        return need + need // 8 + 6, need // 32 + 4


#: What a set does in a signature: index and probe with a whole subset, probe only with one, and both again with a
#: subset that lacks an element. Two subsets that both lack an element prove nothing. With 4 added, a row only marks
#: that a task has members of this signature, which travel on their own. RARE is the fallback's.
WHOLE, ASKS, LACKS, ASKS_LACKS, MARK, RARE = 0, 1, 2, 3, 4, 8
#: A signature keeps its 53 highest bits, so that one with a role takes 7 bytes where rows are many.
_DROPPED = np.uint64(11)
_KEY_BYTES = 7


def short(sig: np.ndarray) -> np.ndarray:
    return (sig >> _DROPPED).view(np.int64)


def probes_of(size: int, bands: Bands, plans: dict) -> dict[int, tuple[int, int, int, int]]:
    """For a set: how many bands below its own -> (band, segments, those with neighbourhoods, units needed)."""
    if size not in plans:
        if len(plans) > 100_000:
            plans.clear()
        asked, own = bands.probes(size), bands.band(size)
        for band in asked:
            if ("band", band) not in plans:
                plans["band", band] = bands.segments(band)
        plans[size] = {own - band: (band, *plans["band", band], bands.units(size, band)) for band in asked}
    return plans[size]


def salts(band: np.ndarray) -> np.ndarray:
    return (band * 0x1000003 + 7).astype(np.uint64)


def signatures(hashes: np.ndarray, sizes: np.ndarray, bands: Bands, plans: dict) -> Iterator[tuple]:
    """What neighbouring sets send out, of all sets together: for each number of bands below their own

    ``sets, band, spare, rows``: the sets that have such a band, the band, how many units each has there beyond what it
    needs, and rows in parts of ``role, place in sets, signature, slot, units``. A slot numbers the segments of all sets,
    in order; units are what the segment is worth. Sets are index and probe in their own band, probes in those below.
    """
    asked = [probes_of(size, bands, plans) for size in sizes.tolist()]
    begins = np.cumsum(sizes) - sizes
    for offset in sorted({offset for probes in asked for offset in probes}):
        sets = np.array([i for i, probes in enumerate(asked) if offset in probes], np.int64)
        band, m, neighbours, need = np.array([asked[i][offset] for i in sets.tolist()], np.int64).T
        salt, base = salts(band), np.cumsum(m) - m
        here = np.zeros(len(sizes), bool)
        here[sets] = True
        own = hashes if here.all() else hashes[np.repeat(here, sizes)]
        of = np.repeat(np.arange(len(sets)), sizes[sets])
        own_salt = salt[of]
        slot = (((mix(own ^ own_salt) >> np.uint64(32)) * m.astype(np.uint64)[of]) >> np.uint64(32)).astype(np.int64) + base[of]
        scrambled = mix(own + own_salt)
        count = np.bincount(slot, minlength=int(m.sum()))
        total = np.zeros(len(count), np.uint64)
        np.add.at(total, slot, scrambled)
        used = np.flatnonzero(count)
        who = np.repeat(np.arange(len(sets)), m)
        segment = np.arange(len(count)) - base[who]
        units = 1 + ((count >= 2) & (segment < neighbours[who]))
        have = np.bincount(who[used], units[used], len(sets)).astype(np.int64)
        spare, keep = np.maximum(have - need, 0), count > 0
        if offset:  # the larger subsets, with a few units to spare
            ranked = used[np.lexsort((-count[used], who[used]))]
            before = np.cumsum(units[ranked]) - units[ranked]
            before -= before[np.searchsorted(who[ranked], np.arange(len(sets)))][who[ranked]]
            chosen = before < (need + need // 16 + 2)[who[ranked]]
            keep[ranked[~chosen]] = False
            spare = np.maximum(np.bincount(who[ranked[chosen]], units[ranked[chosen]], len(sets)).astype(np.int64) - need, 0)
        rows = []
        for i in np.flatnonzero(have < need).tolist():
            begin = begins[sets[i]]
            sig = short(mix(hashes[begin : begin + min(need[i], sizes[sets[i]])] ^ salt[i]))
            rows.append((RARE, np.full(len(sig), i), sig, np.full(len(sig), base[i]), np.ones(len(sig), np.int64)))
            if offset:
                keep[base[i] : base[i] + m[i]] = False
            else:
                spare[i] = 2 * sizes[sets[i]]  # nothing to ask for in this way
        whole, lacks = (ASKS, ASKS_LACKS) if offset else (WHOLE, LACKS)
        number = segment.astype(np.uint64) * _MIX[1] + salt[who]
        sent = np.flatnonzero(keep)
        rows.append((whole, who[sent], short(mix(total[sent] ^ number[sent])), sent, units[sent]))
        rich = np.flatnonzero((keep & (units == 2))[slot])
        at = slot[rich]
        rows.append((lacks, who[at], short(mix((total[at] - scrambled[rich]) ^ number[at])), at, units[at]))
        yield sets, band, spare, rows


_CLASS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("cls", pa.int64())])
_CLASS_SQL = "doc_id long, n_shingles long, key binary, cls long"
_SENT = pa.schema([("part", pa.int64()), ("kind", pa.int8()), ("block", pa.binary())])
_SENT_SQL = "part long, kind byte, block binary"
_MEMBER_SQL = "sig long, cls long, leader long, role long"
_MEMBER = pa.schema([(n, pa.int64()) for n in ("sig", "cls", "leader", "role")])
_ALLOTTED = pa.schema([*((n, pa.int64()) for n in ("sig", "cls", "comp", "role", "size", "band")), ("asks", pa.bool_()), ("sketch", pa.binary())])
_ALLOTTED_SQL = "sig long, cls long, comp long, role long, size long, band long, asks boolean, sketch binary"
_ASKED = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Longest parity sketch of a set, in 64-bit words; up to it a sketch has 32 bits for every element partners may differ in.
SKETCH_WORDS = 32
#: What stands for a signature in the one row that brings a set's sketch for a band.
SKETCH_ROW = -1
#: Pairs of sketches that a task compares for one signature; signatures with more are cut into a grid of such cells.
CELL_PAIRS = 1 << 24
#: Where probes and indexed sets meet. Signatures of different bands may be equal by chance, and prove nothing then.
_CELL = ["sig", "band", "cell"]


def class_key(words: bytes, salt: int) -> tuple[bytes, int]:
    """The name of a sequence of words as ``plain`` gives it, and its number."""
    key = hashlib.blake2b(words, digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return key, int.from_bytes(key[:8], "little", signed=True)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of as many rows as are worked on together, so that few texts are held in Python at a time."""
    for batch in batches:
        for begin in range(0, len(batch), STRETCH_TEXTS):
            yield batch.slice(begin, STRETCH_TEXTS)


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns))


def pack(sig: np.ndarray, role: np.ndarray, cls: np.ndarray) -> bytes:
    """Rows of neighbouring sets as one block: each set once with its number of rows, then 7 bytes a row."""
    start = np.concatenate([[True], cls[1:] != cls[:-1]])
    count = np.diff(np.flatnonzero(start), append=len(cls)).astype("<u4")
    key = (sig.astype("<u8") << np.uint64(3) | role.astype("<u8")).astype("<u8")
    key = np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES])
    return len(count).to_bytes(4, "little") + cls[start].astype("<i8").tobytes() + count.tobytes() + key.tobytes()


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(signature and role as one number, set) of a block's rows."""
    n = int.from_bytes(block[:4], "little")
    cls = np.frombuffer(block, "<i8", n, 4)
    count = np.frombuffer(block, "<u4", n, 4 + 8 * n)
    key = np.frombuffer(block, np.uint8, -1, 4 + 12 * n).reshape(-1, _KEY_BYTES)
    whole = np.zeros((len(key), 8), np.uint8)
    whole[:, :_KEY_BYTES] = key
    return whole.view("<u8").ravel().astype(np.int64), np.repeat(cls, count)


def send(batches: Iterator[pa.RecordBatch], bands: Bands, n: int, salt: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Signatures of the distinct sets of a task, in blocks by the part in which a signature meets those of other tasks.

    Of signatures that several sets of a buffer share, the members go to any part, each with the buffer's leader, and
    one mark goes to the signature's own: so no signature, however frequent, puts more than a row for each buffer there.
    """
    plans: dict = {}
    sigs, roles, owners, held, seen, turn = [], [], [], 0, set(), 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal turn
        sig, role, cls = np.concatenate(sigs), np.concatenate(roles), np.concatenate(owners)
        order = np.argsort(sig << 4 | role)
        start = np.concatenate([[True], sig[order][1:] != sig[order][:-1]])
        run = np.cumsum(start) - 1
        several = (np.bincount(run)[run] >= 2) | (role[order] == RARE)
        leader = cls[order][np.flatnonzero(start)][run]
        alone = np.sort(order[~several])  # back in the order of sets
        mark = order[several & start & (role[order] != RARE)]
        own = np.concatenate([alone, mark])
        part, code = sig[own] % parts, np.concatenate([role[alone], role[mark] | MARK])
        by_part = np.argsort(part, kind="stable")
        part, code, own = part[by_part], code[by_part], own[by_part]
        sig_of, cls_of = sig[own], cls[own]
        edges = np.searchsorted(part, np.arange(parts + 1))
        out = []
        for i in np.flatnonzero(np.diff(edges)):
            at = slice(edges[i], edges[i + 1])
            out.append((int(i), 0, pack(sig_of[at], code[at], cls_of[at])))
        passed = order[several]
        lead = np.where(role[passed] == RARE, cls[passed], leader[several])
        for i in range(0, len(passed), 50_000):
            some = slice(i, i + 50_000)
            rows = np.stack([sig[passed][some], cls[passed][some], lead[some], role[passed][some]]).astype("<i8")
            turn += 1
            out.append((int(mix(np.array([turn ^ int(sig[0])], np.int64).view(np.uint64))[0] % np.uint64(parts)), 1, rows.tobytes()))
        for x in (sigs, roles, owners):
            x.clear()
        for i in range(0, len(out), 64):
            yield batch_of(_SENT, zip(*out[i : i + 64]))

    for batch in slices(batches):
        texts, names = [], []
        for doc_id, text in rows_of(batch):
            words = plain(text)
            key, cls = class_key(words, salt)
            if doc_id is None or not words or key in seen:
                continue
            if len(seen) > 1_000_000:
                seen.clear()
            seen.add(key)
            texts.append(words)
            names.append(cls)
        for some in stretches(texts):
            name, parts_of = np.array(names[some], np.int64), []
            for sets, _, _, rows in signatures(*shingle_sets(texts[some], n), bands, plans):
                parts_of += [(sets[at], np.full(len(sig), role), sig) for role, at, sig, *_ in rows]
            at, role, sig = (np.concatenate(x) for x in zip(*parts_of))
            by_set = np.argsort(at.astype(np.uint16), kind="stable")
            sigs.append(sig[by_set])
            roles.append(role[by_set])
            owners.append(name[at[by_set]])
            held += len(sig)
            if held > BUFFER_SIGNATURES:
                yield from flush()
                held = 0
    if held:
        yield from flush()


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks sorted by part, the rows whose signature another set has, with the run's first set as leader.

    A set comes from every task that has a copy of its text; its own copies are no partners, and one row stands for them.
    """
    blocks: list[tuple[np.ndarray, np.ndarray]] = []
    now = None

    def done() -> Iterator[pa.RecordBatch]:
        key, cls = (np.concatenate(x) for x in zip(*blocks))
        blocks.clear()
        order = np.argsort(key, kind="stable")
        sig, role, cls = key[order] >> 3, key[order] & 7, cls[order]
        start = np.concatenate([[True], sig[1:] != sig[:-1]])
        run, first = np.cumsum(start) - 1, np.flatnonzero(start)
        # a run needs two sets, and a row that holds a whole subset
        good = (np.minimum.reduceat(cls, first) != np.maximum.reduceat(cls, first)) & (np.minimum.reduceat(role & 3, first) <= ASKS)
        at = np.flatnonzero(good[run])
        if not len(at):
            return
        at = at[np.lexsort((cls[at], role[at], sig[at]))]
        at = at[np.concatenate([[True], (sig[at][1:] != sig[at][:-1]) | (role[at][1:] != role[at][:-1]) | (cls[at][1:] != cls[at][:-1])])]
        yield from _members(sig[at], cls[at], cls[first][run[at]], role[at])

    for batch in batches:
        for part, kind, block in rows_of(batch):
            if kind:
                yield from _members(*np.frombuffer(block, "<i8").reshape(4, -1))
                continue
            if blocks and part != now:
                yield from done()
            now = part
            blocks.append(unpack(block))
    if blocks:
        yield from done()


def _members(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), 100_000):
        yield batch_of(_MEMBER, [c[i : i + 100_000] for c in columns])


def linked(a: bytes, b: bytes, n: int, num: int, known: dict) -> bool:
    """Whether two texts link, by their whole shingles."""
    sets = []
    for text in (a, b):
        if text not in known:
            if len(known) > 1:
                known.clear()
            known[text] = shingle_set(plain(text).split(), n)
        sets.append(known[text])
    x, y = sets
    shared = len(x & y)
    return bool(x) and 100 * shared >= num * (len(x) + len(y) - shared)


#: Bits of the filter that picks texts before they are shuffled, in pages of 32,768 bits; 2 MB, whatever the data.
FILTER_PAGES = 512


def page_table(ids: DataFrame, column: str) -> DataFrame:
    """A fixed-size bitmap of hashed ids as ``page, bits``: every id passes, few others do while ids are few."""
    spot = ids.select(F.pmod(F.xxhash64(column), F.lit(FILTER_PAGES * 32768)).alias("spot"))
    return spot.groupBy(F.expr("spot div 32768").alias("page")).agg(F.bitmap_construct_agg(F.col("spot") % 32768).alias("bits"))


def page_filter(ids: DataFrame, column: str) -> dict[int, np.ndarray]:
    """The pages of ``page_table`` for use inside tasks. Bounded by their number."""
    return {r["page"]: np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little") for r in page_table(ids, column).collect()}


def passing(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` passes the bitmap of ``ids``; texts of others never leave Spark."""
    spots = rows.withColumn("spot", F.pmod(F.xxhash64(column), F.lit(FILTER_PAGES * 32768)))
    met = spots.join(F.broadcast(page_table(ids, column)), F.expr("spot div 32768 = page"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(spot % 32768 div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return met.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(spot % 8 as int))")) != 0).select(*rows.columns)


def passes(spots: np.ndarray, pages: dict[int, np.ndarray]) -> np.ndarray:
    out = np.zeros(len(spots), bool)
    for page in np.unique(spots // 32768):
        if int(page) in pages:
            at = spots // 32768 == page
            out[at] = pages[int(page)][spots[at] % 32768] == 1
    return out


def sketches(hashes: np.ndarray, sizes: np.ndarray, band: np.ndarray, bands: Bands) -> list[bytes]:
    """Bits that each element of a set toggles at a place of its own: sets differ in at least as many elements as bits."""
    words = {}
    for one in np.unique(band).tolist():
        high = bands.starts[one + 1] - 1
        words[one] = min(SKETCH_WORDS, bands.difference(high, high) // 2 + 1)
    bits = 64 * np.array([words[one] for one in band.tolist()], np.int64)
    ends, of = np.cumsum(bits), np.repeat(np.arange(len(sizes)), sizes)
    place = (mix(hashes ^ np.uint64(0xD6E8FEB86659FD93)) % bits.astype(np.uint64)[of]).astype(np.int64) + (ends - bits)[of]
    packed = np.packbits((np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[(end - n) // 8 : end // 8] for end, n in zip(ends.tolist(), bits.tolist())]


def sketch(hashes: np.ndarray, band: int, bands: Bands) -> bytes:
    return sketches(hashes, np.array([len(hashes)]), np.array([band]), bands)[0]


def ask(batches: Iterator[pa.RecordBatch], num: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    """From rows sorted by signature, band and cell to pairs of a probe and an indexed set that the signature, their sizes
    and their sketches allow, of different components; with ``nearest`` only each probe's pair of the least difference."""
    for table in whole_groups(batches, _CELL, 50_000):
        starts = np.unique(_group_starts(table, _CELL))
        for begin, end in zip(starts, [*starts[1:], len(table)]):
            group = table.slice(begin, end - begin)
            asks, cls, comp, role, size = (group[c].to_numpy() for c in ("asks", "cls", "comp", "role", "size"))
            # sketches are as long as their band's
            bits = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint64).reshape(len(group), -1)
            probes, index = np.flatnonzero(asks), np.flatnonzero(~asks)
            step = max(1, (1 << 21) // max(1, len(index) * bits.shape[1]))
            for at in range(0, len(probes) if len(index) else 0, step):
                p = probes[at : at + step, None]
                both = size[p] + size[index]
                room = both - 2 * -(-num * both // (100 + num))
                apart = np.bitwise_count(bits[p[:, 0], None] ^ bits[None, index]).sum(axis=2, dtype=np.int64)
                fits = (size[index] <= size[p]) & (100 * size[index] >= num * size[p]) & (comp[p] != comp[index])
                fits &= ((role[p] <= ASKS) | (role[index] == WHOLE)) & (apart <= room)
                if nearest:
                    i = np.flatnonzero(fits.any(axis=1))
                    j = np.where(fits, apart, 1 << 40)[i].argmin(axis=1)
                else:
                    i, j = np.nonzero(fits)
                for some in range(0, len(i), 100_000):
                    own = slice(some, some + 100_000)
                    yield batch_of(_ASKED, (cls[p[i[own], 0]], cls[index[j[own]]]))


class Join:
    """One run over one table; each method is a step."""

    def __init__(self, docs: DataFrame, n: int, num: int, id_col: str, text_col: str) -> None:
        self.rows, self.n, self.num, self.bands = id_and_body(docs, id_col, text_col), n, num, Bands(num)
        for self.salt in range(8):  # 64 bits name a class; another salt if two classes ever got one name
            self.members = pin(self.rows.mapInArrow(self.classify(), _CLASS_SQL), "jaccard-documents")
            classes = self.members.where("n_shingles > 0 and doc_id is not null").groupBy("cls", "key")
            self.classes = pin(classes.agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("size")), "jaccard-classes")
            if not self.classes.groupBy("cls").count().where("count > 1").take(1):
                return
        raise RuntimeError("class names collide under every salt")

    def classify(self):
        n, salt = self.n, self.salt

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                texts = [plain(text) for text in batch.column(1).to_pylist()]
                size, full = np.zeros(len(texts), np.int64), [i for i, text in enumerate(texts) if text]
                for some in stretches([texts[i] for i in full]):
                    size[full[some]] = shingle_sets([texts[i] for i in full[some]], n)[1]
                yield batch_of(_CLASS, (batch.column(0).to_pylist(), size, *zip(*(class_key(text, salt) for text in texts))))

        return run

    def signed(self) -> DataFrame:
        bands, n, salt = self.bands, self.n, self.salt
        # of all rows, as copies of a text in different tasks are all sent
        shingles = self.members.where("doc_id is not null").agg(F.sum("n_shingles")).first()[0] or 0
        parts = max(64, shingles // PART_SHINGLES)
        sent = self.rows.mapInArrow(lambda batches: send(batches, bands, n, salt, parts), _SENT_SQL)
        met = sent.repartition("part").sortWithinPartitions("part").mapInArrow(meet, _MEMBER_SQL)
        return pin(met, "jaccard-signatures")

    def sized(self, pairs: DataFrame) -> DataFrame:
        """Pairs that are linked if their sets share enough; others sizes forbid."""
        size = self.classes.select("cls", "size", "first")
        pairs = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs.join(size.toDF("a", "size_a", "first_a"), "a").join(size.toDF("b", "size_b", "first_b"), "b")
        return pairs.where(f"100 * least(size_a, size_b) >= {self.num} * greatest(size_a, size_b)")

    def texts(self, wanted: DataFrame, label: str) -> DataFrame:
        """``cls, body`` for ``wanted(cls, doc_id)``, one text each; others are dropped before anything is shuffled."""
        salt = self.salt

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                out = [(doc_id, class_key(plain(text), salt)[1], text) for doc_id, text in rows_of(batch) if doc_id is not None]
                if out:
                    yield batch_of(pa.schema([("doc_id", pa.int64()), ("cls", pa.int64()), ("body", pa.binary())]), zip(*out))

        picked = passing(self.rows, wanted, "doc_id").mapInArrow(name, "doc_id long, cls long, body binary")
        texts = picked.join(wanted, ["doc_id", "cls"], "left_semi")
        return pin(texts.dropDuplicates(["cls"]).select("cls", "body"), f"{label}-texts")

    def verified(self, pairs: DataFrame, label: str) -> DataFrame:
        """Those of the pairs whose whole texts link."""
        n, num = self.n, self.num
        pairs = pin(self.sized(pairs), f"{label}-pairs")
        side = lambda s: F.struct(F.col(s).alias("cls"), F.col(f"first_{s}").alias("doc_id"))
        wanted = pairs.select(F.explode(F.array(side("a"), side("b"))).alias("x")).select("x.*").distinct()
        texts = self.texts(wanted, label)

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict = {}
            for batch in batches:
                out = [(a, b) for a, b, x, y in rows_of(batch) if linked(x, y, n, num, known)]
                if out:
                    yield batch_of(pa.schema([("a", pa.int64()), ("b", pa.int64())]), zip(*out))

        both = pairs.select("a", "b").join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
        return pin(both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"), f"{label}-links")

    def named(self, links: DataFrame, label: str) -> DataFrame:
        return pin(components(links, label).withColumnsRenamed({"node": "cls", "component": "comp"}), f"{label}-components")

    def unsettled(self, members: DataFrame, comps: DataFrame) -> DataFrame:
        """Members of signatures that still hold several components, with the component of each."""
        own = members.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        mixed = own.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high")
        return own.join(mixed.select("sig"), "sig", "left_semi")

    def shared(self, members: DataFrame) -> DataFrame:
        """Each set of ``members(sig, cls, comp)`` with its signatures, in order, and how many sets share each."""
        costs = members.groupBy("sig").agg(F.count("*").alias("cost"))
        own = members.join(costs, "sig").groupBy("cls", "comp")
        own = own.agg(F.sort_array(F.collect_set(F.struct("sig", "cost"))).alias("shared"))
        own = own.join(self.classes.select("cls", F.col("first").alias("doc_id")), "cls")
        return pin(own.select("cls", "doc_id", "comp", F.col("shared.sig").alias("sigs"), F.col("shared.cost").alias("costs")), "jaccard-shared")

    def allotted(self, own: DataFrame) -> DataFrame:
        """``sig, cls, comp, role, size, band, asks, sketch`` for ``shared``: which signatures a set still asks in.

        A set may spare as many units as it has beyond its need in a band; it spares the segments whose signatures most
        sets share. A set with no more units here than it can spare asks nowhere, and a text with few shared
        signatures is soon done with. ``sketch`` comes once for each set and band, in a row of its own.
        """
        n, bands = self.n, self.bands
        texts = self.texts(own.select("cls", "doc_id"), "jaccard-unsettled")

        def allot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plans: dict = {}
            for batch in slices(batches):
                texts = [plain(text) for text in batch.column(4).to_pylist()]
                for some in stretches(texts):
                    part = batch.slice(some.start, some.stop - some.start)
                    cls, comp = (part.column(i).to_numpy() for i in (0, 1))
                    known = pc.list_flatten(part.column(2)).to_numpy() + (np.repeat(np.arange(len(part)), pc.list_value_length(part.column(2)).to_numpy()) << 53)
                    costs = pc.list_flatten(part.column(3)).to_numpy()
                    hashes, sizes = shingle_sets(texts[some], n)
                    for sets, band, spare, rows in signatures(hashes, sizes, bands, plans):
                        rows = [(np.full(len(at), role), at, *row) for role, at, *row in rows if role != RARE]
                        role, at, sig, slot, units = (np.concatenate(x) for x in zip(*rows))
                        spot = np.minimum(np.searchsorted(known, sig + (sets[at] << 53)), len(known) - 1)
                        here = np.flatnonzero(known[spot] == sig + (sets[at] << 53))
                        if not len(here):
                            continue
                        role, at, sig, slot, units, cost = (x[here] for x in (role, at, sig, slot, units, costs[spot]))
                        which, first, place = np.unique(slot, return_index=True, return_inverse=True)
                        dear, who, worth = np.zeros(len(which), np.int64), at[first], units[first]
                        np.maximum.at(dear, place, cost)
                        by_cost = np.lexsort((-dear, who))
                        spent = np.cumsum(worth[by_cost])
                        spent -= (spent - worth[by_cost])[np.searchsorted(who, who)]
                        asks = np.zeros(len(which), bool)
                        asks[by_cost] = spent > spare[who]
                        own = sets[at]
                        yield batch_of(_ALLOTTED, (sig, cls[own], comp[own], role, sizes[own], band[at], asks[place], pa.nulls(len(sig), pa.binary())))
                        at = np.unique(at)
                        own, here = sets[at], np.zeros(len(sizes), bool)
                        here[own] = True
                        drawn = sketches(hashes[np.repeat(here, sizes)], sizes[own], band[at], bands)
                        same = lambda value: np.full(len(own), value)
                        yield batch_of(_ALLOTTED, (same(SKETCH_ROW), cls[own], comp[own], same(0), sizes[own], band[at], same(False), drawn))

        rows = own.drop("doc_id").join(texts, "cls").select("cls", "comp", "sigs", "costs", "body")
        return rows.mapInArrow(allot, _ALLOTTED_SQL)

    def cells(self, members: DataFrame) -> DataFrame:
        """Probes and indexed sets with their sketches, in the signatures that some probe could not spare.

        All rows of most signatures are in one cell, those of a frequent one in a square grid of cells: each probe in one
        row of it and each indexed set in one column.
        """
        rows = pin(self.allotted(self.shared(members)), "jaccard-allotted")
        sketches = rows.where(f"sig = {SKETCH_ROW}").select("cls", "band", "sketch")
        rows, indexed = rows.where(f"sig != {SKETCH_ROW}").drop("sketch"), F.col("role").isin(WHOLE, LACKS)
        stats = rows.groupBy("sig", "band").agg(F.count_if("asks").alias("p"), F.count_if(indexed).alias("q"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        side = F.ceil(F.sqrt(F.col("p") * F.col("q") / F.lit(float(CELL_PAIRS))))
        rows = rows.join(stats.where("p > 0 and q > 0 and low != high").select("sig", "band", side.alias("side")), ["sig", "band"])
        rows = rows.where(F.col("asks") | indexed).join(sketches, ["cls", "band"])
        spot, along = F.pmod(F.xxhash64("cls"), F.col("side")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("side") - 1))
        columns = ["sig", "band", "cls", "comp", "role", "size", "sketch"]
        probes = rows.where("asks").select(*columns, "side", spot.alias("spot"), along.alias("other"))
        probes = probes.select(*columns, F.lit(True).alias("asks"), (F.col("spot") * F.col("side") + F.col("other")).alias("cell"))
        index = rows.where(indexed).select(*columns, "side", spot.alias("spot"), along.alias("other"))
        index = index.select(*columns, F.lit(False).alias("asks"), (F.col("other") * F.col("side") + F.col("spot")).alias("cell"))
        return pin(probes.unionByName(index), "jaccard-cells")

    def across(self, cells: DataFrame, nearest: bool) -> DataFrame:
        """Pairs of a probe and an indexed set of another component that met in a cell; all, or each probe's nearest."""
        num = self.num
        met = cells.repartition(*_CELL).sortWithinPartitions(*_CELL)
        return met.mapInArrow(lambda batches: ask(batches, num, nearest), "a long, b long").distinct()

    def rare(self, members: DataFrame) -> DataFrame:
        """Pairs of probes that had too few units: any of their first shingles, as many as units needed, is in every partner."""
        asked = members.where(f"role = {RARE}").select("sig", F.col("cls").alias("a"))
        pages, bands, n, salt = page_filter(asked, "sig"), self.bands, self.n, self.salt
        if not pages:
            return asked.select("a", F.col("a").alias("b"))

        def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                texts = [plain(text) if doc_id is not None else b"" for doc_id, text in rows_of(batch)]
                texts = [text for text in texts if text]
                for some in stretches(texts):
                    hashes, sizes = shingle_sets(texts[some], n)
                    salted = salts(np.array([bands.band(size) for size in sizes.tolist()], np.int64))
                    names = np.array([class_key(text, salt)[1] for text in texts[some]], np.int64)
                    sig = short(mix(hashes ^ np.repeat(salted, sizes)))
                    yield batch_of(pa.schema([("sig", pa.int64()), ("b", pa.int64())]), (sig, np.repeat(names, sizes)))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(passes(batch.column(2).to_numpy(zero_copy_only=False), pages)))

        spots = self.rows.mapInArrow(shingles, "sig long, b long").withColumn("spot", F.pmod(F.xxhash64("sig"), F.lit(FILTER_PAGES * 32768)))
        return asked.join(spots.mapInArrow(pick, "sig long, b long, spot long").select("sig", "b"), "sig").select("a", "b")

    def components(self) -> DataFrame:
        signed = self.signed()
        met = signed.where(f"role != {RARE}")
        # The first pairs: sets and their leaders. Links of sets beyond a few shingles share several signatures, so a
        # single one is not worth a look yet; nothing is lost, as signatures whose members stay apart are taken up below.
        star = met.where("cls != leader").groupBy("cls", "leader").agg(F.count("*").alias("times"))
        star = star.join(self.classes.select("cls", "size"), "cls").where("times >= if(size < 8, 1, 3)")
        links = self.verified(star.select(F.col("cls").alias("a"), F.col("leader").alias("b")), "jaccard-star")
        comps = self.named(links, "jaccard-star")
        left = pin(self.unsettled(met.where(f"role < {MARK}").select("sig", "cls"), comps), "jaccard-unsettled")
        cells = self.cells(left)
        # Nearest pairs first: their links join most components that belong together, so few sets are left that have
        # many pairs when all pairs that may still link two components are looked at.
        links = links.union(self.verified(self.across(cells, True).union(self.rare(signed)), "jaccard-nearest"))
        comps = self.named(links, "jaccard-nearest").withColumnRenamed("comp", "joined")
        cells = cells.join(comps, "cls", "left").withColumn("comp", F.coalesce("joined", "cls")).drop("joined")
        more = self.verified(self.across(cells, False), "jaccard-across")
        return self.named(links.union(more), "jaccard")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold_percent: int = 80
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Shingles are ``n`` words (A-Z lower-cased, split at ASCII white space); a shorter text is one shingle. Two documents
    link when 100 * |intersection| >= threshold_percent * |union|; ``component_id`` is the smallest id reachable by
    links. Null, empty and blank texts have no shingles and are linked with nothing, so they are their own component.
    Rows without an id link with nothing and have a null component. Rows repeated with one id are one node if their
    texts agree, and else each text links for itself. An empty table gives an empty result; other columns are not read.

    No link between different texts is lost: see the module for why. Steps are written below ``spark.checkpoint.dir``.
    """
    join = Join(docs, n, threshold_percent, id_col, text_col)
    comps = join.components()
    first = join.classes.select("cls", "first")
    named = first.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = named.join(least, "comp").select(F.col("cls").alias("c"), "component_id")
    linkable = F.expr("case when n_shingles > 0 and doc_id is not null then cls end")
    out = join.members.join(named, linkable == F.col("c"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
