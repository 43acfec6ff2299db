"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over them, each filter's largest response in a window counts, and a
softmax over the languages follows. The network is trained in numpy on windows of a bounded sample of labelled texts,
and applied in tasks to all windows of every text; a text's prediction is the mean over its windows, by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import batch_of, body

#: Filter starts per window; windows of a text do not overlap, but their filters see into the next one.
WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS, EMBED = 8, 8
#: A byte that UTF-8 never uses stands for what is beyond the text; its embedding is zero.
PAD = 0xFF
#: Windows that one multiplication takes.
CHUNK = 256

UNKNOWN = "und"


def has_letter(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts in lower case: bytes, the text each belongs to, and how many of its starts are in the text."""
    reach = max(WIDTHS) - 1
    sizes = np.array([len(t) for t in texts], int)
    counts = -(-sizes // WINDOW) + 1  # the last one is empty: filters see into it, never into the next text
    first = np.concatenate([[0], np.cumsum(counts)])
    laid = np.full(first[-1] * WINDOW + reach, PAD, np.uint8)
    for at, text in zip(first * WINDOW, texts):
        laid[at : at + len(text)] = np.frombuffer(text.lower(), np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(laid, WINDOW + reach)[::WINDOW]
    owner = np.repeat(np.arange(len(texts)), counts)
    inside = np.clip(sizes[owner] - (np.arange(first[-1]) - first[owner]) * WINDOW, 0, WINDOW)
    return rows[inside > 0], owner[inside > 0], inside[inside > 0]


@dataclass
class ByteNetwork:
    """``embed`` of bytes, ``filters`` of all widths (those narrower than the widest hold zeros), and the softmax layer."""

    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray

    def __post_init__(self) -> None:
        reach = np.repeat(WIDTHS, FILTERS)
        self.mask = (np.repeat(np.arange(max(WIDTHS)), EMBED)[:, None] < reach).astype(np.float32)

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 0) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        wide, n = max(WIDTHS) * EMBED, FILTERS * len(WIDTHS)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        net = cls(languages, draw(256, EMBED, scale=0.5), draw(wide, n, scale=0.3), np.zeros(n, np.float32), draw(n, len(languages), scale=0.2), np.zeros(len(languages), np.float32))
        net.embed[PAD] = 0
        net.filters *= net.mask
        return net

    def columns(self, rows: np.ndarray) -> np.ndarray:
        """What each filter start of each window sees: (windows, WINDOW, widest * EMBED)."""
        seen = np.ascontiguousarray(self.embed[rows])
        wide, step = max(WIDTHS) * EMBED, seen.itemsize * EMBED
        shape = (len(rows), rows.shape[1] - max(WIDTHS) + 1, wide)
        return np.lib.stride_tricks.as_strided(seen, shape, (step * rows.shape[1], step, seen.itemsize)).reshape(-1, wide)

    def responses(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        columns = self.columns(rows)
        return columns, (columns @ self.filters).reshape(len(rows), -1, self.filters.shape[1])

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        """Log probabilities of every window."""
        out = []
        for at in range(0, len(rows), CHUNK):
            pooled = self.responses(rows[at : at + CHUNK])[1].max(axis=1)
            out.append(log_softmax(np.maximum(pooled + self.bias, 0) @ self.weight + self.offset))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

    def gradients(self, rows: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, for embed, filters, bias, weight and offset."""
        columns, response = self.responses(rows)
        n, m = len(rows), response.shape[2]
        at = response.argmax(axis=1)
        pooled = np.take_along_axis(response, at[:, None], axis=1)[:, 0] + self.bias
        hidden = np.maximum(pooled, 0)
        d = np.exp(log_softmax(hidden @ self.weight + self.offset))
        d[np.arange(n), label] -= 1
        d /= n
        d_pooled = (d @ self.weight.T) * (pooled > 0)
        # Only the start of a filter's largest response learns.
        start = np.arange(n)[:, None] * response.shape[1] + at
        d_filters = np.einsum("nm,nmk->km", d_pooled, columns[start]) * self.mask
        d_seen = (d_pooled[:, :, None] * self.filters.T[None]).reshape(n, m, max(WIDTHS), EMBED)
        bytes_at = rows[np.arange(n)[:, None, None], at[:, :, None] + np.arange(max(WIDTHS))]
        d_embed = np.zeros_like(self.embed)
        np.add.at(d_embed, bytes_at, d_seen)
        d_embed[PAD] = 0
        return [d_embed, d_filters, d_pooled.sum(axis=0), hidden.T @ d, d.sum(axis=0)]

    def train(self, rows: np.ndarray, label: np.ndarray, steps: int = 600, batch: int = 64, rate: float = 5e-3, seed: int = 0) -> ByteNetwork:
        """Adam over batches with every language as likely; half the windows are cut to a random length, as short texts are."""
        rng = np.random.default_rng(seed)
        of_class = [np.flatnonzero(label == k) for k in range(len(self.languages))]
        weights = [self.embed, self.filters, self.bias, self.weight, self.offset]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        place = np.arange(rows.shape[1])
        for step in range(1, steps + 1):
            drawn = rng.integers(len(of_class), size=batch)
            picked = rows[[of_class[k][rng.integers(len(of_class[k]))] for k in drawn]]
            length = np.where(rng.random(batch) < 0.5, rows.shape[1], rng.integers(12, rows.shape[1], size=batch))
            picked = np.where(place < length[:, None], picked, PAD).astype(np.uint8)
            slower = rate * min(1.0, 2.0 * (1 - (step - 1) / steps))
            for w, g, a, b in zip(weights, self.gradients(picked, drawn), first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= slower * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


_WINDOWS = pa.schema([("lang", pa.string()), ("window", pa.binary())])


def sampled_windows(labelled: DataFrame, docs_per_language: int, windows_per_doc: int, max_languages: int) -> DataFrame:
    """``lang, window`` of a sample of ``labelled(key, text, lang)``: bounded by the product of the three parameters."""
    rows = labelled.where(F.col("lang").isNotNull() & has_letter())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    found = counts.collect()  # max_languages rows
    # Twice as many as needed are drawn by a hash before they are ranked, so ranking is bounded too.
    share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], 2.0 * docs_per_language / r["n"])]) if found else F.lit(None).cast("map<string,double>")
    draw = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 40))
    drawn = rows.select("lang", "text", draw.alias("draw")).where(F.col("draw") < share[F.col("lang")] * float(1 << 40))
    ranked = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("body").to_pylist()):
                rows, _, _ = windows_of([text])
                picked = sorted({(2 * k + 1) * len(rows) // (2 * windows_per_doc) for k in range(windows_per_doc)})
                out += [(lang, rows[at].tobytes()) for at in picked]
            if out:
                yield batch_of(_WINDOWS, zip(*out))

    chosen = ranked.where(F.col("place") <= docs_per_language).select("lang", body().alias("body"))
    return chosen.mapInArrow(run, "lang string, window binary")


def fit_language_network(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_language: int = 400,
    windows_per_doc: int = 4,
    max_languages: int = 256,
    steps: int = 600,
    seed: int = 0,
) -> ByteNetwork:
    """Train on windows spread over whole texts: at most ``docs_per_language`` texts, drawn by a hash, of each of the
    ``max_languages`` most frequent languages, and ``windows_per_doc`` windows of each. Rows without language or letters
    are left out; without any row the network knows no language."""
    rows = labelled.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sample = sorted(tuple(r) for r in sampled_windows(rows, docs_per_language, windows_per_doc, max_languages).collect())
    languages = sorted({lang for lang, _ in sample})
    net = ByteNetwork.fresh(languages, seed)
    if len(languages) < 2:
        return net
    windows = np.frombuffer(b"".join(w for _, w in sample), np.uint8).reshape(len(sample), -1)
    return net.train(windows, np.array([languages.index(lang) for lang, _ in sample]), steps, seed=seed)


_PREDICTED = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])


def predict_language(docs: DataFrame, net: ByteNetwork, text_col: str = "text", carry: list[Column] | None = None) -> DataFrame:
    """The columns of ``carry`` (default ``doc_id``), ``lang_pred, score`` for every row of ``docs``.

    ``score`` is the network's probability of ``lang_pred``. Texts that are null, empty or without any letter are
    ``und`` with score 0, and so is every text if the network knows no language. All windows of very long texts count;
    equal texts get equal predictions, ties go to the first language in code-point order, an empty table gives an empty
    result. Other columns are not read, whatever their names.
    """
    kept = docs.select(F.struct(*(carry or [F.col("doc_id")])).alias("carried"), body(text_col).alias("body"), has_letter(text_col).alias("known"))
    languages = net.languages

    def judge(texts: list[bytes]) -> list[tuple[str, float]]:
        if not languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        rows, owner, inside = windows_of(texts)
        total = np.zeros((len(texts), len(languages)))
        np.add.at(total, owner, net.log_odds(rows) * inside[:, None])
        p = np.exp(log_softmax(total / np.array([len(t) for t in texts])[:, None]))
        return [(languages[k], float(row[k])) for row, k in zip(p, p.argmax(axis=1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, bodies = batch.column("known").to_pylist(), batch.column("body")
            out: list = [(UNKNOWN, 0.0)] * len(known)
            waiting: list[tuple[int, bytes]] = []
            held = 0
            for at in (i for i, yes in enumerate(known) if yes):
                waiting.append((at, bodies[at].as_py()))
                held += len(waiting[-1][1])
                if held > 1 << 20:
                    for (i, _), result in zip(waiting, judge([t for _, t in waiting])):
                        out[i] = result
                    waiting, held = [], 0
            if waiting:
                for (i, _), result in zip(waiting, judge([t for _, t in waiting])):
                    out[i] = result
            if out:
                found = batch_of(_PREDICTED, zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column("carried"), *found.columns], names=["carried", "lang_pred", "score"])

    carried = kept.schema["carried"].dataType.simpleString()
    judged = kept.mapInArrow(run, f"carried {carried}, lang_pred string, score double")
    return judged.select("carried.*", "lang_pred", "score")
