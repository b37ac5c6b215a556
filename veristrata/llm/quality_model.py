"""Quality scores by regularised quadratic discriminant analysis.

Each text becomes a few transformed statistics of its words, lines and characters. Each
class has a mean and a covariance that is shrunk towards the pooled one and towards a
multiple of the identity; their Cholesky factors are kept, so a score is two triangular
solves: the difference of the classes' Mahalanobis log densities, tempered for the
statistics' dependence, through a logistic.

Defined results: a null or empty text has statistics of 0 and is scored as such; with
labels of one class only, every score is that class; without labels 0.5; rows equal in doc_id
and text are learnt once and scored alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of
from .features import TEXT_BYTES, learn, sample, score, text_matrix

#: Most labelled documents of each class that the model is fitted on.
SAMPLE_EACH = 4000
SHRINK_POOLED, SHRINK_IDENTITY, TEMPER = 0.1, 0.02, 0.5
THRESHOLD = 0.7

_KIND = np.full(256, 5, np.int64)  # 0 space, 1 upper, 2 lower, 3 digit, 4 sentence marks, 5 other ASCII, 6 beyond ASCII
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[48:58] = 3
_KIND[[33, 44, 46, 58, 59, 63]] = 4
_KIND[128:] = 6


def statistics(texts: list[str]) -> np.ndarray:
    """A row of transformed statistics for each text."""
    raw, at = text_matrix(texts)
    out = np.zeros((len(texts), 12))
    for i, text in enumerate(texts):
        words, lines = text.split(), text.split("\n")
        n, chars = max(1, len(words)), max(1, int(at[i + 1] - at[i]))
        k = np.zeros(7)
        for a in range(int(at[i]), int(at[i + 1]), TEXT_BYTES):
            k += np.bincount(_KIND[raw[a : min(a + TEXT_BYTES, int(at[i + 1]))]], minlength=7)
        different = len(set(words))
        short = sum(len(w) <= 3 for w in words)
        pairs = len(set(zip(words, words[1:], strict=False)))
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        out[i] = (
            np.log1p(len(words)),
            np.log1p((chars - k[0]) / n),
            np.sqrt(k[5] / chars),
            np.sqrt(k[4] / n),
            np.sqrt(k[3] / chars),
            np.sqrt(k[1] / chars),
            np.sqrt(text.count("!") / n),
            np.sqrt(1 - different / n) if words else 0.0,
            np.sqrt(1 - pairs / max(1, n - 1)) if n > 1 else 0.0,
            np.sqrt(same / n),
            np.sqrt(short / n),
            np.sqrt(1 - len(set(lines)) / len(lines)),
        )
    return out


class QuadraticModel:
    """Fitted on rows x and labels 0 or 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, temper: float = TEMPER) -> None:
        self.temper, self.classes = temper, sorted({int(v) for v in y})
        if len(self.classes) < 2:
            return
        x = x.astype(np.float64)
        self.middle, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = (x - self.middle) / self.scale
        covariances = [np.cov(z[y == c].T, bias=True) if (y == c).sum() > 1 else np.zeros((z.shape[1],) * 2) for c in (0, 1)]
        pooled = sum(cov * (y == c).mean() for c, cov in zip((0, 1), covariances, strict=True))
        self.parts = []
        for c, cov in zip((0, 1), covariances, strict=True):
            few = min(1.0, z.shape[1] / max(1, (y == c).sum()))  # more shrinkage for a class of few rows
            keep = max(SHRINK_POOLED, few)
            cov = (1 - keep) * cov + keep * pooled
            cov = (1 - SHRINK_IDENTITY) * cov + SHRINK_IDENTITY * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.parts.append((z[y == c].mean(0), factor, np.log(np.diag(factor)).sum()))

    def log_density(self, z: np.ndarray, c: int) -> np.ndarray:
        """The class's normal log density but for a constant, by a triangular solve for all rows at once."""
        mean, factor, log_root = self.parts[c]
        away = z - mean
        out = np.empty_like(away)
        for j in range(away.shape[1]):
            out[:, j] = (away[:, j] - out[:, :j] @ factor[j, :j]) / factor[j, j]
        return -0.5 * (out**2).sum(1) - log_root

    def scores(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), float(self.classes[0]) if self.classes else 0.5)
        z = (x - self.middle) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.temper * (self.log_density(z, 1) - self.log_density(z, 0)), -30, 30)))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        s = self.scores(statistics([t or "" for t in texts]))
        return [s, (s >= THRESHOLD).astype(np.int32)]


def fit(docs: DataFrame, labels: DataFrame, held: int = 2, modulus: int = 4, each: int = SAMPLE_EACH) -> QuadraticModel:
    """Fitted on at most `each` labelled documents of each class outside the held-out fold; a doc_id with two labels counts as the lower."""
    open_ = bucket_of("doc_id", modulus) != held
    known = labels.filter(open_ & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    x, y = learn(sample(docs.filter(open_), F.col("quality"), each, "quality", known), statistics)
    return QuadraticModel(x, y)


def grade(docs: DataFrame, model: QuadraticModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns `keep`, score and predicted."""
    return score(docs, model, "score double, predicted int", keep)
