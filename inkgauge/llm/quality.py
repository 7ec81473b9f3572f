"""A regularised quadratic discriminant of document quality.

A text becomes a vector of transformed statistics. Each class has a mean and a covariance, shrunk towards the pooled covariance
and the identity; the score is the difference of the two log-densities (Mahalanobis distances by Cholesky factors that are made
once and sent with the task), put through a logistic calibration fitted on the same rows. Class moments are sums over all
labelled rows of the learning fold, added up by Spark; the driver sees two matrices. The calibration takes CALIBRATION rows.

Defined cases: a null or empty text is the vector of zeros and gets a score like any other; labels other than 0 and 1, rows of
the held-out fold and rows with a null doc_id teach nothing; repeated labels count as often as they occur; without two rows of
either class every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgauge.llm import common

CALIBRATION = 20_000
POOLED, ROUND = 0.2, 0.02  # shares of the pooled covariance and of the identity
N_FEATURES = 22


def statistics(text: str) -> list[float]:
    """N_FEATURES transformed statistics: logarithms of counts, square roots of shares."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    hist = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    size = hist.sum()
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip()]
    grams = max(1, n - 2)
    upper, lower, digits = hist[65:91].sum(), hist[97:123].sum(), hist[48:58].sum()
    share = hist[hist > 0] / size
    counts = np.log1p([n, len(lines), lengths.max(), n / len(lines)])
    shares = np.sqrt(
        np.clip(
            [
                1 - len(set(lines)) / len(lines),
                1 - len(set(zip(words, words[1:], words[2:]))) / grams if n > 2 else 0.0,
                len(set(words)) / n,
                upper / max(1, upper + lower),
                digits / size,
                hist[ord("|")] / n,
                (hist[ord("#")] + hist[ord("*")] + hist[ord("$")] + hist[ord("%")] + hist[ord("&")] + hist[ord("<")] + hist[ord(">")]) / n,
                (hist[ord("!")] + hist[ord("?")]) / n,
                hist[ord(".")] / n,
                hist[ord(",")] / n,
                hist[ord("\n")] / n,
                (hist[ord("@")] + hist[ord("/")] + hist[ord("=")] + hist[ord("_")]) / n,
                hist[128:].sum() / size,
                (lengths <= 3).mean(),
                (lengths >= 12).mean(),
            ],
            0,
            4,
        )
    )
    return [*counts.tolist(), *shares.tolist(), float(lengths.mean()), float(lengths.std()), float(-(share * np.log(share)).sum())]


@dataclass
class Model:
    """Means, inverse Cholesky factors and log-determinants of the classes 0 and 1, after standardisation; calibration a * d + b."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    a: float = 1.0
    b: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, without priors."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        density = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.difference(x) + self.b, -60, 60)))


def calibrate(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression of y on d, a little regularised, by Newton steps."""
    centre, spread = float(np.median(d)), float(np.std(d)) or 1.0
    x = np.stack([np.clip((d - centre) / spread, -6, 6), np.ones_like(d)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6]), x.T @ (y - p) - np.array([1e-2, 1e-6]) * w)
        w = w + np.clip(step, -2, 2)
    slope = max(float(w[0]), 1e-3) / spread
    return slope, float(w[1]) - slope * centre


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of labels.quality from the rows that may be learnt from; None without two rows of each class."""
    docs, labels = common.columns(docs, doc_id="long", text="string"), common.columns(labels, doc_id="long", quality="int")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.portions(whole):
                x = pa.array([statistics(t) for t in common.texts(batch)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x], names=["doc_id", "x"])

    known = labels.where("quality in (0, 1) and doc_id is not null").where(~common.held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("y"))
    known = common.table(known, "quality-labels")
    may = docs.where(F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id")))
    # few ids go to the texts, so only labelled ones are measured; else all are, and the short vectors go to the labels
    wanted = common.checked_broadcast(known)
    if wanted is not known:
        may = may.join(wanted.select("doc_id").hint("broadcast"), "doc_id", "left_semi")
    vectors = may.mapInArrow(measure, "doc_id long, x array<double>")
    rows = common.table(vectors.join(wanted, "doc_id").select("doc_id", "y", "x"), "quality-rows")
    common.drop(known)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + N_FEATURES, 1 + N_FEATURES))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, N_FEATURES)
            x, y = np.insert(x, 0, 1.0, 1), batch.column("y").to_numpy()
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "value"])

    sums = np.zeros(2 * (1 + N_FEATURES) ** 2)
    for r in rows.mapInArrow(moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():  # two matrices
        sums[r["at"]] = r["value"]
    sums = sums.reshape(2, 1 + N_FEATURES, 1 + N_FEATURES)
    counts = sums[:, 0, 0]
    if counts.min() < 2:
        common.drop(rows)
        return None
    means = sums[:, 0, 1:] / counts[:, None]
    covs = [sums[c, 1:, 1:] / counts[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    centre = sums[:, 0, 1:].sum(0) / counts.sum()
    scale = np.sqrt(np.maximum(np.diag(sums[:, 1:, 1:].sum(0)) / counts.sum() - centre**2, 1e-8))
    unit = np.outer(scale, scale)
    pooled = (counts[0] * covs[0] + counts[1] * covs[1]) / counts.sum() / unit
    factors, logdets = [], []
    for c in (0, 1):
        shrunk = (1 - POOLED - ROUND) * covs[c] / unit + POOLED * pooled + ROUND * np.eye(N_FEATURES)
        low = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(low))
        logdets.append(2 * float(np.log(np.diag(low)).sum()))
    model = Model(centre, scale, [(m - centre) / scale for m in means], factors, logdets)
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION).select("y", "x").toArrow()
    x = sample.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)
    model.a, model.b = calibrate(model.difference(x), sample.column("y").to_numpy().astype(float))
    common.drop(rows)
    return model


def score(text: Column, model: Model | None) -> Column:
    """The probability that a text is of quality 1."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(model.score(np.array([statistics(t) for t in texts])))

    return run(F.coalesce(text, F.lit("")))
