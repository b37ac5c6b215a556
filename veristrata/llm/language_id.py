"""Language identification by hierarchical discrimination.

Features are shares of hashed byte n-grams of the whole text. Languages that are close by
their mean features form families (average-link clustering until the family count is
reached). One-versus-one linear support vector machines first choose the family, then the
language within it. The score is the product of both choices' shares, each a logistic of
the winner's mean margin.

Defined results: a null text or one without a letter is `und` with score 0; with no
labelled document to learn from every text is `und`; with one language learnt it is always
predicted, with score 1; equal margins go to the first language by code point; rows equal in
doc_id and text are learnt once and all identified alike; texts of any length are hashed whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of
from .features import NgramHasher, learn, sample, score

#: Most labelled documents of one language that the models are fitted on; every language is learnt.
SAMPLE_EACH = 400
BUCKETS = 2048


def train_svm(x: np.ndarray, y: np.ndarray, epochs: int = 60, c: float = 20.0) -> np.ndarray:
    """A linear machine with squared hinge loss for y in -1, 1, by dual coordinate descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diag = 0.5 / (c * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))))
    norm = (x * x).sum(1) + diag
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            step = max(alpha[i] - (y[i] * (w @ x[i]) - 1 + diag[i] * alpha[i]) / norm[i], 0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                moved = max(moved, abs(step) * norm[i] ** 0.5)
        if moved < 1e-3:
            break
    return w


def pairwise(x: np.ndarray, y: np.ndarray, names: list) -> list[tuple[int, int, np.ndarray]]:
    """A machine for each pair of names."""
    out = []
    for a, b in combinations(range(len(names)), 2):
        at = (y == names[a]) | (y == names[b])
        out.append((a, b, train_svm(x[at], np.where(y[at] == names[a], 1.0, -1.0))))
    return out


def families(means: np.ndarray, count: int) -> list[list[int]]:
    """Average-link clustering of the languages' mean features by cosine."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    near, groups = unit @ unit.T, [[i] for i in range(len(means))]
    while len(groups) > count:
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: near[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] += groups.pop(b)
    return groups


class LanguageModel:
    def __init__(self, x: np.ndarray, y: np.ndarray, hasher: NgramHasher) -> None:
        self.hasher, self.languages = hasher, sorted(set(y))
        self.groups: list[list[int]] = []
        if not self.languages:
            return
        means = np.stack([x[y == lang].mean(0) for lang in self.languages])
        self.groups = families(means, max(1, round(len(self.languages) ** 0.5)))
        family = {self.languages[i]: g for g, members in enumerate(self.groups) for i in members}
        self.first = pairwise(x, np.array([family[v] for v in y]), list(range(len(self.groups))))
        self.within = [pairwise(x, y, [self.languages[i] for i in g]) for g in self.groups]

    @staticmethod
    def choose(x: np.ndarray, machines: list, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The winner by votes, margins breaking ties, and its share."""
        if n == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        votes, margin = np.zeros((len(x), n)), np.zeros((len(x), n))
        for a, b, w in machines:
            m = x @ w[:-1] + w[-1]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            margin[:, a] += m
            margin[:, b] -= m
        best = np.argmax(votes + np.tanh(margin / n) / 4, axis=1)
        return best, 1 / (1 + np.exp(-2 * np.clip(margin[np.arange(len(x)), best] / (n - 1), -20, 20)))

    def __call__(self, texts: list[str | None]) -> list[list]:
        lang, scores = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and self.groups and any(map(str.isalpha, t))]
        for a in range(0, len(at), 256):
            rows = at[a : a + 256]
            x = self.hasher([texts[i] for i in rows])
            family, sure = self.choose(x, self.first, len(self.groups))
            for g, members in enumerate(self.groups):
                if len(mine := np.flatnonzero(family == g)):
                    best, share = self.choose(x[mine], self.within[g], len(members))
                    for k, b, s in zip(mine.tolist(), best.tolist(), share.tolist(), strict=True):
                        lang[rows[k]], scores[rows[k]] = self.languages[members[b]], float(sure[k] * s)
        return [lang, scores]


def fit(docs: DataFrame, held: int = 2, modulus: int = 4, each: int = SAMPLE_EACH) -> LanguageModel:
    """Fitted on at most `each` documents of each language outside the held-out fold; equal rows count once."""
    known = docs.filter((bucket_of("doc_id", modulus) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    hasher = NgramHasher(buckets=BUCKETS)
    x, y = learn(sample(known, F.col("lang"), each, "language"), hasher)
    return LanguageModel(x if len(x) else np.zeros((0, BUCKETS)), y, hasher)


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns `keep`, lang_pred and score."""
    return score(docs, model, "lang_pred string, score double", keep)
