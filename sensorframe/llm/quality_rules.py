"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

Statistics of whole texts become a vector of four transformed rates. Each (language, source) group, each language and
the table as a whole get an MCD estimate by concentration steps that run for all groups at once: distances are counted
in fixed bins, the bins that hold the closest half give the next mean and covariance. Step sums are combined map-side, so a
source of any size is no single task's work, and a group's estimate is one small row. A text is judged by its finest
group that has enough texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from ..scratch import pin
from .common import batch_of, body
from .text_stats import base_counts

DIMENSIONS = 4
#: Added to the variances: what harmless texts may differ by even where all others are alike, as in texts without symbols.
#: The last two statistics are bounded, by 1 and, after the base rule, by 0.548: a cutoff of 6 deviations lies below that, so that either alone can reject a text of a group where it is rare.
FLOOR = (0.15**2, 0.05**2, 0.12**2, 0.08**2)
#: Bins for the logarithm of a squared distance, from e^-12 in steps of 1/16.
_BINS, _STEP, _LOW = 640, 16.0, -12.0


def rates(n: int, chars: int, symbols: int, dup: int, repeated: int, lines: int) -> list[float]:
    """Symbols per character, word length, repeated lines and words; shrunk by some virtual words and lines."""
    return [
        float(np.log1p(100 * symbols / (chars + 20.0))),
        float(np.log((chars + 100.0) / (n + 20.0))),
        float(np.sqrt(dup / (lines + 4.0))),
        float(np.sqrt(repeated / (n + 20.0))),
    ]


_STATS = pa.schema(
    [
        *((c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        ("lang", pa.string()),
        ("source", pa.string()),
        ("x", pa.list_(pa.float64())),
    ]
)
_STATS_SQL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lang string, source string, x array<double>"
_KEEP = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                n, chars, symbols, dup, repeated, lines = base_counts(text)
                rows.append((doc_id, n, chars, symbols, dup, repeated, lang, source, rates(n, chars, symbols, dup, repeated, lines)))
            if rows:
                yield batch_of(_STATS, zip(*rows))

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        body(text_col).alias("body"),
    )
    return rows.mapInArrow(run, _STATS_SQL)


@pandas_udf(ArrayType(DoubleType()))
def whitening(moments: pd.Series) -> pd.Series:
    """From (factor, n, sums, products) of a group: mean, and inverse Cholesky factor row by row, of its scaled covariance plus floor."""
    d, out = DIMENSIONS, []
    for m in moments:
        factor, m = m[0], np.asarray(m[1:], float)
        mean = m[1 : 1 + d] / m[0]
        cov = np.zeros((d, d))
        cov[np.tril_indices(d)] = m[1 + d :] / m[0]
        cov = cov + np.tril(cov, -1).T - np.outer(mean, mean)
        cov = factor * (cov + cov.T) / 2
        # rounding can leave a tiny negative variance, far below the floor
        out.append(np.concatenate([mean, np.linalg.inv(np.linalg.cholesky(cov + np.diag(FLOOR))).ravel()]).tolist())
    return pd.Series(out)


def distance():
    """Squared Mahalanobis distance of ``x`` under ``estimate``, as a column of plain arithmetic."""
    d, total = DIMENSIONS, F.lit(0.0)
    x = [F.col("x")[i] - F.col("estimate")[i] for i in range(d)]
    for i in range(d):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col("estimate")[d + i * d + j] * x[j]
        total = total + part * part
    return total


def moment_columns() -> list:
    x = [F.col("x")[i] for i in range(DIMENSIONS)]
    products = [x[i] * x[j] for i in range(DIMENSIONS) for j in range(i + 1)]
    return [F.count("*").cast("double").alias("m0"), *[F.sum(c).alias(f"m{k}") for k, c in enumerate([*x, *products], 1)]]


def consistency(support: float) -> float:
    """What the covariance of the closest ``support`` of a normal sample in four dimensions must be multiplied by."""
    inside = lambda x: 1 - np.exp(-x / 2) * (1 + x / 2)
    low, high = 0.0, 100.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if inside(middle) < support else (low, middle)
    return float(support / (1 - np.exp(-low / 2) * (1 + low / 2 + low * low / 8)))


def mcd_estimates(rows: DataFrame, steps: int = 5, support: float = 0.5) -> DataFrame:
    """``grp, n, estimate`` for ``rows(grp, x)``: MCD by concentration steps from the coordinatewise median and spread.

    ``support`` is the share of a group's rows that the determinant is taken over. Distances fall into bins of 1/16 in
    the logarithm of their square, and the support ends with a bin; so a step is a sum by (group, bin), the same on
    any number of partitions up to rounding, and needs no sorted group.
    """
    d = DIMENSIONS
    middle = [F.percentile_approx(F.col("x")[i], 0.5, 2000).alias(f"c{i}") for i in range(d)]
    wide = [F.percentile_approx(F.col("x")[i], F.array(F.lit(0.25), F.lit(0.75)), 2000).alias(f"q{i}") for i in range(d)]
    start = rows.groupBy("grp").agg(F.count("*").alias("n"), *middle, *wide)
    flat = [F.lit(0.0)] * (d * d)
    for i in range(d):
        spread = (F.col(f"q{i}")[1] - F.col(f"q{i}")[0]) / 1.349
        flat[i * d + i] = 1 / F.sqrt(spread * spread + F.lit(FLOOR[i]))
    estimates = pin(start.select("grp", "n", F.array(*[F.col(f"c{i}") for i in range(d)], *flat).alias("estimate")), "mcd")
    k = 1 + d + d * (d + 1) // 2
    for _ in range(steps):
        near = rows.join(estimates, "grp").withColumn("bin", F.least(F.lit(_BINS), F.greatest(F.lit(0), F.floor((F.log(distance() + 1e-9) - _LOW) * _STEP))).cast("int"))
        bins = near.groupBy("grp", "n", "bin").agg(*moment_columns())
        upto = Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        inside = bins.withColumn("before", F.coalesce(F.sum("m0").over(upto), F.lit(0.0))).where(F.col("before") < F.ceil(support * F.col("n")))
        sums = inside.groupBy("grp", "n").agg(*[F.sum(f"m{i}").alias(f"m{i}") for i in range(k)])
        estimates = pin(sums.select("grp", "n", whitening(F.array(F.lit(consistency(support)), *[F.col(f"m{i}") for i in range(k)])).alias("estimate")), "mcd")
    return estimates


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_words: int = 20,
    repeat_percent: int = 30,
    min_group: int = 200,
    cutoff: float = 6.0,
    steps: int = 5,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance``.

    ``base_failed`` is the plain rule on too few or too often repeated words. Texts that pass it are kept if their robust
    distance from their group is at most ``cutoff`` standard deviations; groups below ``min_group`` such texts are judged
    by their language, languages below it by the whole table. Null texts have no words and fail; a null language or
    source counts as the name ""; null ids and repeated rows are judged like others; an empty table gives an empty
    result. Other columns are not read.
    """
    stats = text_statistics(docs, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    stats = pin(stats.withColumn("base_failed", failed), "quality-statistics")
    levels = F.array(F.struct(F.lit("").alias("l"), F.lit("").alias("s"), F.lit(0).alias("level")), F.struct(F.col("lang").alias("l"), F.lit("").alias("s"), F.lit(1).alias("level")), F.struct(F.col("lang").alias("l"), F.col("source").alias("s"), F.lit(2).alias("level")))
    rows = stats.where(~F.col("base_failed")).select("x", F.explode(levels).alias("grp"))
    estimates = mcd_estimates(rows, steps)
    estimates = estimates.where((F.col("n") >= min_group) | (F.col("grp.level") == 0)).select("grp", "estimate")
    own = F.array(*[levels[i] for i in (2, 1, 0)])
    # the estimates that apply, finest first; a text meets at most three
    keys = stats.where(~F.col("base_failed")).select("lang", "source").distinct().withColumn("grp", F.explode(own))
    best = keys.join(estimates, "grp").groupBy("lang", "source").agg(F.max_by("estimate", "grp.level").alias("estimate"))
    judged = stats.join(best, ["lang", "source"], "left").withColumn("distance", F.sqrt(distance()))
    kept = ~F.col("base_failed") & (F.col("distance") <= cutoff)
    return judged.select(*_KEEP, "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), F.when(~F.col("base_failed"), F.col("distance")).alias("distance"))
