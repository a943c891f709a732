"""Quality scores: random-indexing word vectors, pooled, under a two-layer network with a calibrated temperature.

Fitting takes a bounded sample of labelled rows (``TRAIN_ROWS`` texts of up to ``TRAIN_CHARS`` characters, all
outside the held-out fold) to the driver.  Each word and shape gets a sparse random index vector; its word
vector is its own index vector plus those of its neighbours.  A document is the mean of its word vectors.
A two-layer network is trained in numpy on four fifths of the sample, and its temperature fitted on the fifth it
did not see.  Scoring reads whole texts, one document at a time, with the tables of the fit (about 8 MB) as a
broadcast.

Defined cases: null text is an empty text, whose vector is the corpus' mean word; unknown words count by their
shape; very long texts are scored whole, in slices of words; null ids are never held out; repeated rows get equal
scores, one row each; a score that equals the threshold is predicted 1; without labels of both kinds every score is
the share of label 1 (0.5 without any label); an empty table gives no rows; ``keep_good`` keeps other columns,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm._util import held_out, release_memory, table
from driftwell.llm.word_rows import Rows, labelled_sample, vocabulary, worker_rows

TRAIN_ROWS, TRAIN_CHARS = 6000, 20_000
WORDS, LEAST, DIMS, SPARSE, REACH, HIDDEN = 20_000, 5, 96, 6, 2, 32
THRESHOLD = 0.3
#: A document's mean holds the corpus' mean word this many times, which steadies very short texts.
PRIOR_WORDS = 3


@dataclass(frozen=True)
class Model:
    name: str
    known: dict[str, int]
    vectors: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float
    prior: np.ndarray | float = 0.0

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(self.vectors.shape[1])
        for i in range(0, len(rows), 50_000):
            total += self.vectors[rows[i : i + 50_000]].sum(0, dtype=np.float64)
        return (total + PRIOR_WORDS * self.prior) / (len(rows) + PRIOR_WORDS)

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        hidden = np.maximum(0, (pooled - mean) / scale @ w1 + b1)
        return 1 / (1 + np.exp(-np.clip((hidden @ w2 + b2) / self.temperature, -30, 30)))


def index_vectors(known: dict[str, int]) -> np.ndarray:
    """Sparse ternary vectors drawn from each word's own hash; row 0, for unknown words, is zero."""
    out = np.zeros((len(known) + 1, DIMS), np.float32)
    for word, row in known.items():
        draw = np.random.default_rng(xxhash.xxh3_64_intdigest(word))
        out[row, draw.choice(DIMS, SPARSE, replace=False)] = draw.choice([-1.0, 1.0], SPARSE)
    return out


def word_vectors(docs: list[np.ndarray], known: dict[str, int]) -> np.ndarray:
    """Own index vector plus the mean of the neighbours', at unit length."""
    index = index_vectors(known)
    size = len(index)
    context = np.zeros_like(index)
    flat = np.concatenate([np.concatenate((d, np.full(REACH, -1, np.int32))) for d in docs] or [np.empty(0, np.int32)]).astype(np.int64)
    for step in range(1, REACH + 1):
        a, b = flat[:-step], flat[step:]
        both = (a >= 0) & (b >= 0)
        pair, n = np.unique(a[both] * size + b[both], return_counts=True)
        for left, right in ((pair // size, pair % size), (pair % size, pair // size)):
            for i in range(0, len(pair), 20_000):
                part = slice(i, i + 20_000)
                np.add.at(context, left[part], index[right[part]] * n[part, None].astype(np.float32))
    seen = np.bincount(flat[flat >= 0], minlength=size)[:, None]
    out = index + context / np.maximum(1, 2 * REACH * seen)
    return (out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))).astype(np.float32)


def _train(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> list[np.ndarray]:
    draw = np.random.default_rng(5)
    p = [draw.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for i in range(0, len(x), batch):
            xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
            hidden = np.maximum(0, xb @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -30, 30))) - yb) / len(xb)
            back = np.outer(error, p[2]) * (hidden > 0)
            grads = [xb.T @ back + decay * p[0], back.sum(0), hidden.T @ error + decay * p[2], error.sum()]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return p


def fit(sample: list[tuple[str, int]]) -> Model:
    y = np.array([float(v) for _, v in sample])
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        flat = np.zeros(DIMS), np.ones(DIMS), np.zeros((DIMS, 1)), np.zeros(1), np.zeros(1), np.array(np.log(share / (1 - share)))
        return Model("flat", {}, np.zeros((1, DIMS), np.float32), flat, 1.0)
    known = vocabulary((t for t, _ in sample), WORDS, LEAST)
    rows = Rows(known)
    docs = [rows.of(t) for t, _ in sample]
    vectors = word_vectors(docs, known)
    seen = np.bincount(np.concatenate(docs), minlength=len(vectors)).astype(float)
    prior = seen @ vectors / max(1.0, seen.sum())
    model = Model("", known, vectors, (), 1.0, prior)
    x = np.array([model.pooled(d) for d in docs])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    aside = np.arange(len(z)) % 5 == 0
    p = _train(z[~aside], y[~aside])
    raw = np.maximum(0, z[aside] @ p[0] + p[1]) @ p[2] + p[3]
    # The temperature with the least log loss of this very network on the part it has not seen.
    heat = np.geomspace(0.5, 8, 60)
    loss = [np.logaddexp(0, np.where(y[aside] == 1, -raw, raw) / h).mean() for h in heat]
    layers = (mean, scale, *p)
    name = xxhash.xxh3_64_hexdigest(b"".join(np.ascontiguousarray(a, np.float64).tobytes() for a in layers))
    return Model(name, known, vectors, layers, float(heat[int(np.argmin(loss))]), prior)


def score(model: Model, text: Column) -> Column:
    """Scores of a text column, batch by batch."""

    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        rows = worker_rows(model.name, model.known)
        return pd.Series(model.scores(np.array([model.pooled(rows.of(t)) for t in batch]).reshape(len(batch), DIMS)))

    return run(F.coalesce(text, F.lit("")))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    model = fit(labelled_sample(docs, labels, "quality", rows, chars))
    release_memory()
    return model


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), score(model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` whose score reaches the threshold, all columns kept."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), score(model, F.col("text")).alias("_score"))
    return rows.filter(F.col("_score") >= threshold).select("_row.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
