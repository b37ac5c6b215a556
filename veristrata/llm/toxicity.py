"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all documents, whatever their
labels, is the unlabelled text. A linear classifier over the words that a text has is trained in numpy on
the non-negative risk: prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),
with the class prior taken from the labelled documents of the training folds. The terms of a
text are its words and the first letters of its longer words. Terms are features if at least
MIN_DOCS positives have them and their share among positives exceeds that among unlabelled
texts by MIN_Z standard errors, however many terms do; one weight is added for each feature that occurs, however
often.

Defined results: a null or empty text has no features and gets the bias's score; without a
confirmed toxic document every score is 0; a doc_id with two labels counts as toxic if one
of them says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, column, small_batches, stage
from .features import letters_of, sample, score

#: Most positives and unlabelled documents that the model is fitted on; what makes a term a feature.
POSITIVES, UNLABELLED, MIN_DOCS, MIN_Z = 4000, 9000, 3, 4.0
PREFIX = 5
THRESHOLD = 0.5


def terms_of(text: str) -> set[str]:
    """The words of a text, and the first letters of longer ones, marked with a star."""
    words = set(letters_of(text))
    return words | {w[:PREFIX] + "*" for w in words if len(w) > PREFIX}


class ToxicityModel:
    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias, self.known = weights, bias, frozenset(weights)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        z = np.array([self.bias + sum(self.weights[w] for w in sorted(self.known.intersection(terms_of(t)))) if t else self.bias for t in texts], np.float64)
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return [s, (s >= THRESHOLD).astype(np.int32)]


def risk_gradient(p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float, beta: float) -> tuple[np.ndarray, bool]:
    """The step's gradient for positives p and unlabelled rows u: of the risk, or where its negative part
    is under -beta that part's, turned around; and which."""
    sp, su = 1 / (1 + np.exp(-p @ w)), 1 / (1 + np.exp(-u @ w))
    up = prior * (p.T @ (sp - 1)) / len(p)
    negative = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
    down = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
    return (up + down, True) if negative >= -beta else (-down, False)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 300, decay: float = 1e-6, beta: float = 0.02) -> np.ndarray:
    """Weights (the last is the bias) for rows of 0 and 1, by Adam on the non-negative risk with the logistic loss."""
    p, u = (np.hstack([m, np.ones((len(m), 1), np.float32)]).astype(np.float32) for m in (positive, unlabelled))
    w = np.zeros(p.shape[1], np.float32)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    rng, step = np.random.default_rng(11), 0
    rate = 0.05
    for epoch in range(epochs):
        rng.shuffle(p)
        rng.shuffle(u)
        parts = max(1, min(8, len(p) // 32))
        for pb, ub in zip(np.array_split(p, parts), np.array_split(u, parts), strict=True):
            g, _ = risk_gradient(pb, ub, w, prior, beta)
            g = g + decay * np.where(np.arange(len(w)) < len(w) - 1, w, 0)
            step += 1
            first = 0.9 * first + 0.1 * g
            second = 0.999 * second + 0.001 * g * g
            w = w - (rate * (1 - epoch / epochs) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def _documents_with(chosen: DataFrame, words: frozenset[str] | None) -> DataFrame:
    """label and words of the chosen documents; all words and an empty one, or those given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text_"):
            found = [["", *terms_of(t or "")] if words is None else sorted(words.intersection(terms_of(t or ""))) for t in column(batch, "text_").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "label_"), pa.array(found, pa.list_(pa.string()))], ["label", "words"])

    return chosen.select("text_", "label_").mapInArrow(run, "label int, words array<string>")


def telling_terms(chosen: DataFrame) -> tuple[list[str], int]:
    """All terms that pass the test for features, the most common first; and how many positives there are."""
    own = F.sum("label").alias("own")
    counts = _documents_with(chosen, None).select("label", F.explode("words").alias("w")).groupBy("w").agg(own, (F.count("*") - F.sum("label")).alias("other"))
    counts = stage(counts.filter((F.col("own") >= MIN_DOCS) | (F.col("w") == "")))
    # The empty word is in every document once: its counts are the documents'.
    total = counts.filter(F.col("w") == "").first()
    if not total or not total["own"]:
        return [], 0
    n1, n0 = float(total["own"]), float(max(1, total["other"]))
    here, there = F.col("own") / F.lit(n1), F.col("other") / F.lit(n0)
    spread = here * (1 - here) / F.lit(n1) + (there * (1 - there) + F.lit(1 / n0)) / F.lit(n0)
    telling = counts.filter((F.col("w") != "") & ((here - there) / F.sqrt(F.greatest(spread, F.lit(1e-12))) >= MIN_Z) & (here >= 3 * there))
    return [r["w"] for r in telling.orderBy(F.desc("own"), "w").select("w").collect()], int(n1)


def fit(docs: DataFrame, labels: DataFrame, held: int = 0, modulus: int = 5, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> ToxicityModel:
    """Fitted on bounded samples outside the held-out fold; rows equal in doc_id and text count once."""
    open_ = bucket_of("doc_id", modulus) != held
    known = labels.filter(open_ & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    share = known.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    if not share["toxic"]:
        return ToxicityModel({}, -30.0)
    prior = min(0.5, max(1e-3, share["toxic"] / share["n"]))
    texts = docs.filter(open_)
    toxic = sample(texts, F.col("label"), positives, "toxic", known.filter("label = 1"))
    # The unlabelled set is drawn from all documents, the toxic ones among them, as the risk assumes.
    chosen = toxic.union(sample(texts, F.lit(0), unlabelled, "plain"))
    names, found = telling_terms(chosen)
    if not found:
        return ToxicityModel({}, -30.0)
    at = {w: i for i, w in enumerate(names)}
    # Joined words in Arrow columns: rows of Python lists would take the driver's memory many times.
    table = _documents_with(chosen, frozenset(names)).select("label", F.array_join("words", " ").alias("words")).toArrow()
    rows = sorted((label, text.split()) for label, text in zip(table["label"].to_pylist(), table["words"].to_pylist(), strict=True))
    x, y = np.zeros((len(rows), len(names)), np.float32), np.array([label for label, _ in rows])
    for i, (_, words) in enumerate(rows):
        x[i, [at[w] for w in words]] = 1
    w = train(x[y == 1], x[y == 0], prior)
    return ToxicityModel({n: float(v) for n, v in zip(names, w[:-1], strict=True)}, float(w[-1]))


def rate(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns `keep`, score and predicted."""
    return score(docs, model, "score double, predicted int", keep)


def clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents that the model does not reject, with the columns they came with, whatever these are called."""
    return score(docs, model, "score double, predicted int", tuple(docs.columns), "predicted = 0")
