"""Quality classifier: regularised quadratic discriminant analysis.

Documents become rows of transformed statistics (docstats.FEATURES). Each class
has a mean and a covariance that is shrunk towards the pooled one and towards a
scaled identity; the Cholesky factors and their inverses are made once and kept with the
model, so that a Mahalanobis distance is one product. A score is
the logistic of the difference of Mahalanobis log-densities plus log prior odds.
Moments are summed on the executors over every labelled training row; only the
sums, of fixed size, come to the driver.

Defined results: null and empty texts are scored as texts of no words; a label
row repeated for a document counts once with its largest label; null labels are
no labels; with a class that has no training row, every score is the share of
label 1 (0.5 without any labels); very long texts are counted whole, as one row of
statistics; repeated document rows are scored each, and each counts in the fit if its id
has a label; equal scores at the threshold are predicted 1; rows without a doc_id are
scored and never learned from; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, fold, materialize, steps, table
from .docstats import FEATURES, features

D = len(FEATURES)
#: Shares of the pooled covariance, and of the scaled identity, in a class covariance.
POOLED, SPHERE = 0.1, 0.02
THRESHOLD = 0.7
#: Log-densities are divided by this before the logistic: statistics of one text aren't independent.
TEMPERATURE = 2.0


@dataclass
class Model:
    """Class means, inverses of the Cholesky factors (lower) and log-determinants, log prior odds."""

    means: np.ndarray
    inverses: np.ndarray
    logdets: np.ndarray
    odds: float
    prior: float
    whole: bool

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.whole:
            return np.full(len(x), self.prior)
        density = [-0.5 * (np.square((x - m) @ f.T).sum(1) + d) for m, f, d in zip(self.means, self.inverses, self.logdets, strict=True)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0] + self.odds) / TEMPERATURE, -500, 500)))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every document."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in steps(batch):
                x = features(data, offsets)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), D).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, D)


def _moments(batches):
    n, s, q = np.zeros(2), np.zeros((2, D)), np.zeros((2, D, D))
    for batch in batches:
        x, y = _matrix(batch.column("x")), batch.column("label").to_numpy(zero_copy_only=False)
        for k in (0, 1):
            own = x[y == k]
            n[k] += len(own)
            s[k] += own.sum(0)
            q[k] += own.T @ own
    yield pa.RecordBatch.from_arrays([pa.array(list(range(2 + 2 * D + 2 * D * D))), pa.array(np.concatenate((n, s.ravel(), q.ravel())))], names=["k", "v"])


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """``labels``: doc_id, label (0 or 1)."""
    labels = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    rows = attach(stats, labels).select("x", "label").mapInArrow(_moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 + 2 * D + 2 * D * D)
    for r in rows:
        flat[r.k] = r.v
    n, s, q = flat[:2], flat[2 : 2 + 2 * D].reshape(2, D), flat[2 + 2 * D :].reshape(2, D, D)
    prior = float(n[1] / n.sum()) if n.sum() else 0.5
    if n.min() < 1:
        return Model(s, q, n, 0.0, prior, False)
    means = s / n[:, None]
    own = q / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (own * n[:, None, None]).sum(0) / n.sum()
    scale = max(float(np.trace(pooled)) / D, 1e-6)
    # a class of few rows leans on the pooled covariance more
    lean = np.maximum(POOLED, D / (D + n))[:, None, None]
    shrunk = (1 - lean) * own + lean * pooled
    shrunk = (1 - SPHERE) * shrunk + SPHERE * scale * np.eye(D)
    factors = np.linalg.cholesky(shrunk)
    logdets = 2 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(1)
    inverses = np.linalg.solve(factors, np.broadcast_to(np.eye(D), factors.shape))
    return Model(means, inverses, logdets, float(np.log(n[1] / n[0])), prior, True)


def classify(stats: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for batch in batches:
            score = model.score(_matrix(batch.column("x"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Learns from labels.quality of the documents outside the held-out fold."""
    stats = materialize(statistics(table(spark, sf_dir, "documents")), "op2")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 4) != 2).select("doc_id", F.col("quality").alias("label"))
    scored = classify(stats, fit(stats, labels))
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
