"""Spelling variants by pivotal grams.

Words one edit apart share most of their bigrams. Bigrams are ordered from rare to frequent; a word's gram prefix is its
three rarest (one edit touches at most two of a word's bigrams, and here every repetition of the third counts too), and
its pivots are two bigrams of the prefix that do not overlap, chosen by dynamic programming for the least total
frequency. One edit leaves one of two disjoint pivots alone, so of two words one edit apart, the one whose prefix ends
earlier in the order has a pivot that is in the other's prefix. Position limits: what lies on one side of that pivot is
then equal in both words, and so is one half of the other side. Pivots and prefix grams are joined on a hash of these
positions and parts, and every pair is verified by its edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import pin
from .common import batch_of, id_and_body

#: The letters of which words are made, with A-Z lower-cased: 26 + 64, so there are at most 8,100 bigrams.
LETTERS = "a-zÀ-ÿ"
LEAST_LETTERS, LEAST_SEEN, TIMES = 7, 2, 10
#: Of how many runs one loses a letter.
DAMAGED = 31
#: Distinct words that one task counts before it passes them on.
COUNTED_WORDS = 200_000

_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def seen_words(doc_id: int | None, text: bytes, runs: re.Pattern) -> Counter:
    """Counted results of one text: runs in lower case, one letter left out where the CRC-32 of id and run says so."""
    begin = zlib.crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
    seen = Counter()
    for run, n in Counter(runs.findall(text.lower().decode(errors="replace"))).items():
        code = zlib.crc32(run.encode(), begin)
        if code % DAMAGED == 0:
            at = code % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LETTERS:
            seen[run] += n
    return seen


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of the words of all whole texts that are long and frequent enough; null texts have none, a null id is empty."""
    runs = re.compile(f"[{LETTERS}]{{{LEAST_LETTERS},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()):
                total.update(seen_words(doc_id, text, runs))
                if len(total) > COUNTED_WORDS:
                    yield batch_of(_COUNTS, (list(total), list(total.values())))
                    total = Counter()
        if total:
            yield batch_of(_COUNTS, (list(total), list(total.values())))

    counted = id_and_body(docs, id_col, text_col).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SEEN)


def gram_prefix(word: str, rank: dict[str, int]) -> tuple[list[int], int]:
    """Positions of the prefix grams in rising order, and the rank where the prefix ends."""
    ranks = [rank[word[at : at + 2]] for at in range(len(word) - 1)]
    last = sorted(ranks)[2]
    return [at for at, own in enumerate(ranks) if own <= last], last


def pivots(word: str, prefix: list[int], seen: dict[str, int]) -> tuple[int, int]:
    """Two positions of ``prefix`` whose bigrams do not overlap, with the least total frequency."""
    best_pair, best_one = (float("inf"), -1, -1), (float("inf"), -1)
    free = 0  # prefix[:free] end before the bigram at hand; best_one is the rarest of them
    for at in prefix:
        while prefix[free] <= at - 2:
            best_one = min(best_one, (seen[word[prefix[free] : prefix[free] + 2]], prefix[free]))
            free += 1
        best_pair = min(best_pair, (best_one[0] + seen[word[at : at + 2]], best_one[1], at))
    return best_pair[1], best_pair[2]


_GRAMS = pa.schema(
    [("word", pa.string()), ("n", pa.int64()), ("last", pa.int32()), ("pivots", pa.list_(pa.int32())), ("prefix", pa.list_(pa.int32()))]
)


def pivotal_grams(words: DataFrame) -> DataFrame:
    """``word, n, last, pivots, prefix`` of ``words(word, n)``, which is read twice; every word has three letters or more."""
    starts = F.explode(F.sequence(F.lit(1), F.char_length("word") - 1))
    grams = words.select("word", starts.alias("at")).groupBy(F.substr("word", "at", F.lit(2)).alias("gram")).count()
    seen = {row["gram"]: row["count"] for row in grams.collect()}  # 8,100 at most, by the alphabet
    rank = {gram: place for place, gram in enumerate(sorted(seen, key=lambda g: (seen[g], g)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                prefix, last = gram_prefix(word, rank)
                rows.append((word, n, last, list(pivots(word, prefix, seen)), prefix))
            if rows:
                yield batch_of(_GRAMS, zip(*rows))

    return words.select("word", "n").mapInArrow(run, "word string, n long, last int, pivots array<int>, prefix array<int>")


def _part(begin: Column, end: Column) -> Column:
    return F.substr("word", begin + 1, end - begin)


def _keys(at: Column, size: Column, shift: Column) -> Column:
    """Hashes of what a word with an untouched bigram at ``at`` shares with one of ``size`` letters.

    ``shift`` is by how many letters this word is longer. Either what stands before the bigram's end is equal, and then
    the first or the second half of the rest; or what stands from the bigram on, and a half of what is before it.
    """
    own = F.char_length("word")
    end, rest = at + 2, size - at - 2
    half = F.call_function("div", rest + 1, F.lit(2))
    there = at - shift  # where the bigram stands in the other word, if the edit is before it
    head = F.call_function("div", there, F.lit(2))
    tail = own - (rest - half)
    before = F.array(
        F.xxhash64(F.lit(0), at, size, _part(F.lit(0), end + half)),
        F.xxhash64(F.lit(1), at, size, _part(F.lit(0), end), _part(tail, own)),
    )
    after = F.array(
        F.xxhash64(F.lit(2), there, size, _part(F.lit(0), head), _part(at, own)),
        F.xxhash64(F.lit(3), there, size, _part(head + shift, own)),
    )
    return F.concat(F.when(rest >= 0, before).otherwise(F.array()), F.when(there >= 0, after).otherwise(F.array()))


def near_words(words: DataFrame) -> DataFrame:
    """``a, na, b, nb``: each pair of ``words(word, n)`` one edit apart, once."""
    grams = pin(pivotal_grams(words), "pivotal-grams")
    size = F.char_length("word")
    pivot = grams.select("word", "n", "last", F.explode("pivots").alias("at"))
    pivot = pivot.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("shift"))
    probes = pivot.select(
        F.explode(_keys(F.col("at"), size - F.col("shift"), F.col("shift"))).alias("key"),
        F.col("word").alias("p"), F.col("n").alias("np"), F.col("last").alias("lastp"),
    )
    listed = grams.select("word", "n", "last", F.explode("prefix").alias("at"))
    index = listed.select(
        F.explode(_keys(F.col("at"), size, F.lit(0))).alias("key"),
        F.col("word").alias("q"), F.col("n").alias("nq"), F.col("last").alias("lastq"),
    )
    found = probes.join(index, "key").where((F.col("lastp") <= F.col("lastq")) & (F.levenshtein("p", "q", 1) == 1))
    first = F.col("p") < F.col("q")
    pairs = found.select(*[F.when(first, x).otherwise(y).alias(name) for x, y, name in (
        (F.col("p"), F.col("q"), "a"), (F.col("np"), F.col("nq"), "na"), (F.col("q"), F.col("p"), "b"), (F.col("nq"), F.col("np"), "nb"),
    )])
    return pairs.distinct()


def last_forms(forms: DataFrame, most: int) -> DataFrame:
    """``word, root``: where following ``forms(word, form)`` ends. ``most`` is the largest count.

    A form is ``TIMES`` as frequent as its word, so a chain takes at most log(most) steps, and paths double each round.
    """
    paths = pin(forms.select("word", F.col("form").alias("root")), "spelling-paths")
    steps = next(k for k in count() if LEAST_SEEN * TIMES**k >= most)
    for _ in range((max(steps, 1) - 1).bit_length()):
        on = paths.select(F.col("word").alias("root"), F.col("root").alias("further"))
        paths = pin(paths.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-paths")
    return paths


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    Words are runs of letters, in lower case for A-Z, of at least seven letters and two occurrences over all texts; one
    run in ``DAMAGED`` of a text loses a letter first. ``form`` is the most frequent word one edit away (the smallest in
    code-point order of equals) if it is ``TIMES`` as frequent, else null; ``root`` is where following forms ends.

    Null and empty texts have no words, very long texts are counted in bounded memory, rows repeated count again, a
    null id stands for an empty one, an empty table gives an empty result; other columns are not read.
    """
    words = pin(count_words(docs, id_col, text_col), "words")
    most = words.agg(F.max("n")).first()[0] or 0
    pairs = near_words(words)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")),
    )
    best = F.min(F.struct(-F.col("m"), F.col("near")))
    near = pairs.select(F.inline(sides)).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    form_n = -F.col("best.col1")
    grown = form_n >= TIMES * F.col("n")
    judged = pin(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(grown, F.col("best.near")).alias("form"), F.when(grown, form_n).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = last_forms(judged.where("form is not null"), most)
    out = judged.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
