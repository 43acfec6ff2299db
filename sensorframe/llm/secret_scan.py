"""Secrets in texts: base patterns, and character Markov models for strings that look random; DataFrame functions only.

Two first-order Markov models over characters, one of random strings and one of ordinary identifiers, are trained from
labelled samples by counting character pairs. Random strings are drawn from every alphabet that secrets are written in,
ordinary runs come from whole texts. A candidate, a long run of key characters, is a secret if its mean
log-likelihood ratio exceeds a threshold.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KINDS = ("assign", "access", "hex", "markov")
#: The base patterns, the least length of a match (of its second group for ``assign``).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
#: Runs that the Markov models judge; they hold no dots, so hosts and sentences without spaces stay apart.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Runs that serve as samples of ordinary words and identifiers, unless they hold ``MIXED``; too short to be judged
#: themselves, so that secrets which no base pattern labels do not become ordinary by training.
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{2,19}(?![A-Za-z0-9+/_=-])"
MIXED = r"[0-9][A-Za-z].*[0-9][A-Za-z]"
SEPARATORS = "_-/=+"
_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
#: What random strings are drawn from, in which lengths, and how many of each alphabet and length.
ALPHABETS = (
    _DIGITS + "abcdef",
    _DIGITS + "ABCDEF",
    _UPPER + _LOWER + _DIGITS,
    _UPPER + _LOWER + _DIGITS + "+/",
    _UPPER + _LOWER + _DIGITS + "-_",
    _LOWER + _DIGITS,
    _UPPER + _DIGITS,
    _UPPER + _LOWER,
    _LOWER,
    _UPPER,
)
LENGTHS = (20, 24, 32, 40, 64)
SAMPLES = 400
_FIRST, _CODES = 33, 94  # printable ASCII without space


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches: array of (start, end, value), in code points; value is the group's.

    The text between matches gives their places: a match begins after all pieces and matches before it.
    """
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(
        F.slice(pieces, 1, F.size(whole)), F.arrays_zip(whole.alias("w"), value.alias("v")), lambda piece, m: F.struct(F.length(piece).alias("gap"), F.length(m["w"]).alias("long"), m["v"].alias("v"))
    )
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,value:string>>")
    found = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, s: F.struct(
            (a["at"] + s["gap"] + s["long"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + s["long"]).alias("end"), s["v"].alias("value")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def base_spans(text: Column) -> list[Column]:
    """The matches of the three base kinds that are long enough."""
    return [
        F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= ASSIGN_LEAST),
        F.filter(matches(text, ACCESS), lambda m: F.length(m["value"]) >= ACCESS_LEAST),
        matches(text, HEX),
    ]


def whole_text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def secret_samples(spark: SparkSession) -> DataFrame:
    """``sample, label``: random strings over every alphabet of ``ALPHABETS`` in every length of ``LENGTHS``, all labelled 1.

    Characters are drawn by a hash of (alphabet, length, sample, place), so the table is the same in every run.
    """
    kinds = spark.range(SAMPLES).select(F.col("id"), F.explode(F.array(*[F.lit(a) for a in ALPHABETS])).alias("a"), F.array(*[F.lit(n) for n in LENGTHS]).alias("n"))
    kinds = kinds.select("id", "a", F.explode("n").alias("n"))
    drawn = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.substring(F.col("a"), F.pmod(F.xxhash64("a", "n", "id", i), F.length("a").cast("long")).cast("int") + 1, F.lit(1)))
    return kinds.select(F.array_join(drawn, "").alias("sample"), F.lit(1).alias("label"))


def shapes(word: Column) -> Column:
    """A word of letters in upper case, in camel case, numbered, and what it shows before, between and after separators."""
    forms = [F.upper(word), F.concat(F.lower(word), F.initcap(word)), F.concat(word, F.pmod(F.crc32(word.cast("binary")), F.lit(100)).cast("string"))]
    for s in SEPARATORS:
        forms += [F.concat(F.right(w, F.lit(1)), F.lit(s + s), F.left(w, F.lit(1))) for w in (word, F.upper(word))]
    return F.array(*forms)


def ordinary_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``sample, label, n`` from all texts: runs of key characters too short to be candidates, labelled 0.

    Each distinct run counts as often as it comes, ``n``, as do the ``shapes`` of those that are letters alone, so that
    identifiers are ordinary also where texts hold only prose. What the base patterns match is taken out first; a run in
    which digits turn to letters more than once is no sample.
    """
    text = F.regexp_replace(whole_text(text_col), f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    runs = docs.select(F.explode(F.regexp_extract_all(text, F.lit(ORDINARY), F.lit(0))).alias("w"))
    runs = runs.groupBy("w").agg(F.count("*").alias("n")).where(~F.col("w").rlike(MIXED))
    word = F.col("w")
    samples = F.when(word.rlike("^[A-Za-z]+$"), F.concat(F.array(word), shapes(word))).otherwise(F.array(word))
    return runs.select(F.explode(samples).alias("sample"), F.lit(0).alias("label"), "n")


def labelled_samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``sample, label, n`` to train on: drawn random strings against ordinary runs of all texts.

    The random class does not come from the texts: what the base patterns find there is mostly hexadecimal, and a model
    of it takes other alphabets for ordinary.
    """
    return secret_samples(docs.sparkSession).withColumn("n", F.lit(1).cast("long")).unionByName(ordinary_samples(docs, text_col))


def train_markov(samples: DataFrame, backoff: float = 8.0) -> list[float]:
    """Log-likelihood ratios of character pairs, random (label 1) against ordinary (label 0), as a table of 94 * 94.

    Every sample counts, ``n`` times if there is such a column. A pair's probability backs off, with the weight of ``backoff`` samples, to how frequent its
    second character is in the class, so that contexts a class has never shown still tell. Pairs with a character outside
    printable ASCII are left out; without samples all ratios are 0.
    """
    chars = F.split("sample", "")
    zipped = F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.struct((F.ascii(a) - _FIRST).alias("a"), (F.ascii(b) - _FIRST).alias("b")))
    times = F.col("n") if "n" in samples.columns else F.lit(1).cast("long")
    pairs = samples.where("label in (0, 1)").select("label", times.alias("n"), F.explode(zipped).alias("p")).select("label", "n", "p.a", "p.b")
    pairs = pairs.where(f"a between 0 and {_CODES - 1} and b between 0 and {_CODES - 1}").groupBy("label", "a", "b").agg(F.sum("n").alias("count"))
    counts = [[[0.0] * _CODES for _ in range(_CODES)] for _ in range(2)]
    for r in pairs.collect():  # at most 2 * 94 * 94 counts
        counts[r["label"]][r["a"]][r["b"]] += r["count"]
    logs = []
    for rows in counts:
        total = sum(map(sum, rows))
        single = [(sum(row[b] for row in rows) + 1) / (total + _CODES) for b in range(_CODES)]
        logs.append([math.log((row[b] + backoff * single[b]) / (sum(row) + backoff)) for row in rows for b in range(_CODES)])
    return [random - ordinary for ordinary, random in zip(*logs)]


def mean_ratio(value: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio over the character pairs of a string."""
    ratios = F.from_json(F.lit(json.dumps([round(x, 6) for x in table])), "array<double>")
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c) - _FIRST)
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.get(ratios, a * _CODES + b))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / F.greatest(F.size(pairs), F.lit(1))


def free_name(docs: DataFrame, name: str = "secrets") -> str:
    """A column name that ``docs`` does not have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def scanned(docs: DataFrame, table: list[float], found: str, text_col: str = "text", threshold: float = 1.0) -> DataFrame:
    """``docs`` with a column ``found`` of (counts, base, found); see ``find_secrets``. Rows stay where they are."""
    text, names = whole_text(text_col), [F.col(f"`{c}`") for c in docs.columns]
    spans = [*base_spans(text), matches(text, CANDIDATE)]
    rows = docs.select(*names, F.struct(*[s.alias(f"s{i}") for i, s in enumerate(spans)]).alias(found))
    at = lambda i: F.col(found)[f"s{i}"]

    def placed(spans: Column, rank: int) -> Column:
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(KINDS[rank]).alias("kind")))

    counts = [F.size(at(i)).cast("long").alias(f"n_{KINDS[i]}") for i in range(3)]
    base = F.array_sort(F.concat(*[placed(at(i), i) for i in range(3)]))
    rows = rows.select(*names, F.struct(*counts, base.alias("base"), at(3).alias("more")).alias(found))
    base = F.col(found)["base"]
    # A candidate inside a base span adds nothing; one that reaches beyond it is judged as a whole.
    inside = lambda m: F.exists(base, lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"]))
    more = F.filter(F.col(found)["more"], lambda m: ~inside(m) & (mean_ratio(m["value"], table) > threshold))
    counts = [F.col(found)[f"n_{k}"].alias(f"n_{k}") for k in KINDS[:3]]
    return rows.select(*names, F.struct(*counts, base.alias("base"), F.array_sort(F.concat(base, placed(more, 3))).alias("found")).alias(found))


def find_secrets(docs: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 1.0) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base, found``.

    ``base`` and ``found`` are arrays of (start, rank, end, kind) in order of start and kind, ends exclusive, in code
    points; ``found`` is ``base`` plus candidates with a mean ratio above ``threshold`` that no base span holds whole, so
    spans may overlap. Null and empty texts have none; null ids and repeated rows are returned as they come; an empty
    table gives none; other columns are not read. Whole texts are scanned, very long ones in one row; there is no shuffle.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return scanned(docs, table, "secrets", "text", threshold).select("doc_id", "secrets.*")


def redact(docs: DataFrame, table: list[float], text_col: str = "text", mark: str = "[SECRET]", threshold: float = 1.0) -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mark``; rows without one are unchanged, null texts too.

    A column ``n_chars`` follows the new length of changed texts. Overlapping spans become one mark. Repeated rows are
    changed alike, an empty table stays empty; other columns are kept, whatever their names.
    """
    mine = free_name(docs)
    rows = scanned(docs, table, mine, text_col, threshold)
    spans = F.col(mine)["found"]
    changed = F.when(F.size(spans) > 0, without(F.col(text_col), spans, mark)).otherwise(F.col(text_col))
    columns = [changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    out = rows.select(*columns, (F.size(spans) > 0).alias(mine))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(mine), F.length(text_col).cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def listed(spans: Column) -> Column:
    """"kind:start:end", comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def without(text: Column, spans: Column, mark: str) -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mark``; ``spans`` in order of start."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
