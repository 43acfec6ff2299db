"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class gets a mean and a covariance that is shrunk towards its diagonal and the pooled covariance; a score is the
logistic of the difference of the two Gaussian log densities, whose Mahalanobis distances use Cholesky factors computed
once on the driver. Sums for the fit are combined map-side, so training sees every labelled row it is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch_of, id_and_body
from .text_stats import base_counts, more_counts

FEATURES = 10


def transformed(text: bytes) -> list[float]:
    """Statistics of a text, transformed towards normal; rates are shrunk by a few virtual words, so that no text divides by zero."""
    n, chars, symbols, dup, repeated, lines = base_counts(text)
    digits, capitals, emphasis, points, distinct = more_counts(text)
    room = chars + 50.0
    return [
        np.log1p(200 * symbols / room),
        np.log((chars + 50.0) / (n + 10.0)),
        np.log1p(200 * emphasis / room),
        np.log1p(50 * points / room),
        np.log1p(50 * capitals / room),
        np.log1p(50 * digits / room),
        np.sqrt(dup / (lines + 5.0)),
        np.sqrt(repeated / (n + 20.0)),
        (distinct + 10.0) / (n + 10.0) + 0.05 * np.log(n + 10.0),
        np.log(n + 10.0),
    ]


_FEATURES = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.float64()))])


def quality_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, features`` of every whole text; null and empty texts get the features of no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            if ids:
                yield batch_of(_FEATURES, (ids, [transformed(t) for t in texts]))

    return id_and_body(docs, id_col, text_col).mapInArrow(run, "doc_id long, features array<double>")


@dataclass(frozen=True)
class QualityModel:
    """Per class: prior log odds part, mean, inverse Cholesky factor, log determinant."""

    log_prior: tuple[float, float]
    mean: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    log_det: tuple[float, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = []
        for prior, mean, whiten, log_det in zip(self.log_prior, self.mean, self.whiten, self.log_det):
            distance = (((x - mean) @ whiten.T) ** 2).sum(axis=1)
            density.append(prior - 0.5 * (distance + log_det))
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit_quality(labelled: DataFrame, to_pooled: float = 0.1, to_diagonal: float = 0.1, floor: float = 1e-2) -> QualityModel:
    """Fit on ``labelled(features, label)``; rows whose label is not 0 or 1 are left out.

    ``to_pooled`` and ``to_diagonal`` are the shrinkage weights, ``floor`` is added to every variance. A class without
    rows takes the other's mean and covariance, so that scores become the prior; with no rows at all they are 0.5.
    """
    d = FEATURES

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            x = np.array(batch.column("features").to_pylist(), float).reshape(-1, d)
            for c in (0, 1):
                own = x[label == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for c in (0, 1):
            yield pa.RecordBatch.from_pydict({"label": pa.array([c] * total.shape[1], pa.int32()), "k": pa.array(range(total.shape[1]), pa.int32()), "v": pa.array(total[c])})

    rows = labelled.where("label in (0, 1)").select("features", F.col("label").cast("int"))
    sums = rows.mapInArrow(moments, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v"))
    total = np.zeros((2, 1 + d + d * d))
    for r in sums.collect():  # 2 * (1 + d + d * d) numbers
        total[r["label"], r["k"]] = r["v"]
    count = total[:, 0]
    if not count.sum():
        zero, one = np.zeros(d), np.eye(d)
        return QualityModel((0.0, 0.0), (zero, zero), (one, one), (0.0, 0.0))
    means, covs = [], []
    for c in (0, 1):
        own = total[c] if count[c] else total[1 - c]
        mean = own[1 : 1 + d] / own[0]
        means.append(mean)
        covs.append(own[1 + d :].reshape(d, d) / own[0] - np.outer(mean, mean))
    share = count / count.sum()
    pooled = share[0] * covs[0] + share[1] * covs[1]
    whiten, log_det = [], []
    for cov in covs:
        cov = (1 - to_pooled) * cov + to_pooled * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + floor * np.eye(d)
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * float(np.log(np.diag(factor)).sum()))
    prior = np.log((count + 1) / (count.sum() + 2))
    return QualityModel(tuple(prior.tolist()), tuple(means), tuple(whiten), tuple(log_det))


_SCORE = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_quality(features: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``quality_features``: the probability of label 1, and 1 from 0.5 on.

    Equal texts get equal scores, empty ones too; null ids and repeated rows are returned as they come, an empty table
    gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("features").to_pylist(), float).reshape(-1, FEATURES)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], schema=_SCORE)

    scored = features.select("doc_id", "features").mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
