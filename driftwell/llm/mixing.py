"""Mixing to target weights with soft membership: document rates by projected-gradient least squares.

A softmax classifier, fitted on a bounded sample of labelled rows, gives each document its domain
posteriors.  A document of n tokens and posteriors p, used at rate r, is expected to bring r n p tokens to
the domains; tokens are white-space words.  Nonnegative rates are fitted so that the domains' totals match their
targets: from rate 1 each step moves every rate along its own posteriors against the totals' error, scaled by the
damped curvature over documents of positive rate, and is projected at zero (and at ``most``, where a caller wants
a largest rate).  The damping fades from step to step.  A step is one aggregate over the table of (n, p); the
driver sees a vector of domains.  Rates become whole copies by rounding up or down at random, by a hash of the id.

Without ``most``, a domain that hardly occurs can ask for any number of copies; a caller whose corpus may lack one gives it.

Targets are weights.  Their common scale gives the ``anchor`` domain ``anchor_rate`` times its natural
tokens, so documents of that domain stay; domains without a weight are to keep their natural tokens.

Defined cases: null text is an empty text with no tokens and the prior's posteriors; very long texts are counted
whole; null ids are allowed; repeated rows are documents of their own; without tokens rates stay 1; targets out of
reach end at the nearest totals that were met; an empty table gives no rows; other columns pass through ``mix``,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm._util import release_memory, stored, table
from driftwell.llm.word_rows import Rows, labelled_sample, vocabulary, worker_rows

TRAIN_ROWS, TRAIN_CHARS, WORDS, LEAST = 6000, 20_000, 4000, 8
DOMAINS = ("clean", "junk", "toxic")
#: The domain of a labelled row.
DOMAIN_SQL = "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'junk' WHEN quality = 1 THEN 'clean' END"
TARGETS = {"clean": 0.93, "junk": 0.03, "toxic": 0.04}
ANCHOR, ANCHOR_RATE = "clean", 1.05
#: Damping relative to the largest curvature, and what is left of it after each step: a domain that hardly occurs
#: is not approached at once through documents that hardly belong to it.
DAMPING, FADE = 1e-3, 0.3
#: Steps end when totals are this close to the targets, or when ``PATIENCE`` steps brought them no nearer by a hundredth.
CLOSE, PATIENCE, NEARER = 1e-6, 5, 0.99


@dataclass(frozen=True)
class Domains:
    name: str
    names: tuple[str, ...]
    known: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, rows: np.ndarray) -> np.ndarray:
        word, n = np.unique(rows, return_counts=True)
        z = np.log1p(n) @ self.weights[word] + self.bias if len(word) else self.bias
        e = np.exp(z - z.max())
        return e / e.sum()


def fit_domains(sample: list[tuple[str, str]], names: tuple[str, ...] = DOMAINS, epochs: int = 120) -> Domains:
    """Softmax regression on logarithms of word counts, by full-batch Adam with weight decay."""
    counts = np.array([sum(v == d for _, v in sample) for d in names], float) + 1
    bias = np.log(counts / counts.sum())
    known = vocabulary((t for t, _ in sample), WORDS, LEAST)
    weights = np.zeros((len(known) + 1, len(names)))
    if known:
        rows = Rows(known)
        made = [np.unique(rows.of(t), return_counts=True) for t, _ in sample]
        # Counts as a sparse matrix: document, word and value of each entry.
        doc = np.repeat(np.arange(len(made)), [len(w) for w, _ in made])
        word = np.concatenate([w for w, _ in made])
        value = np.log1p(np.concatenate([n for _, n in made]))
        y = np.array([[v == d for d in names] for _, v in sample], float)
        p, m, v = [weights, bias], [0.0, 0.0], [0.0, 0.0]
        for t in range(1, epochs + 1):
            z = np.stack([np.bincount(doc, value * p[0][word, k], len(y)) for k in range(len(names))], 1) + p[1]
            e = np.exp(z - z.max(1, keepdims=True))
            error = (e / e.sum(1, keepdims=True) - y) / len(y)
            back = np.stack([np.bincount(word, value * error[doc, k], len(weights)) for k in range(len(names))], 1)
            for k, g in enumerate((back + 1e-4 * p[0], error.sum(0))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        weights, bias = p
    weights[0] = 0  # words without a row say nothing
    name = xxhash.xxh3_64_hexdigest(weights.tobytes() + bias.tobytes())
    return Domains(name, names, known, weights, bias)


def membership(model: Domains, text: Column) -> Column:
    """Struct of n (tokens) and p (posteriors) for a text column."""

    @F.pandas_udf("n long, p array<double>")
    def run(batch: pd.Series) -> pd.DataFrame:
        rows = worker_rows(model.name, model.known)
        made = [rows.of(t) for t in batch]
        return pd.DataFrame({"n": [len(r) for r in made], "p": [model.posteriors(r) for r in made]})

    return run(F.coalesce(text, F.lit("")))


def rate(p: str, steps: list[list[float]], most: float | None = None) -> Column:
    """The rate after ``steps``: from 1, each moves along the posteriors and is projected at the bounds."""
    r = F.lit(1.0)
    for step in steps:
        for d, s in enumerate(step):
            r = r + F.col(p)[d] * F.lit(float(s))
        r = F.greatest(F.lit(0.0), r)
        r = r if most is None else F.least(F.lit(float(most)), r)
    return r


def fit_rates(members: DataFrame, targets: list[float], most: float | None = None) -> list[list[float]]:
    """Steps of the projected gradient for ``members(n, p)`` towards target totals."""
    goal, steps, damping = np.array(targets), [], DAMPING
    size, best, kept, idle = len(goal), np.inf, 0, 0
    n, p, r = F.col("n").cast("double"), [F.col("p")[d] for d in range(size)], F.col("_r")
    free = r > 0 if most is None else (r > 0) & (r < most)
    sums = [F.sum(r * n * p[d]) for d in range(size)]
    sums += [F.sum(F.when(free, n * p[a] * p[b])) for a in range(size) for b in range(a, size)]
    while True:
        got = [x or 0.0 for x in members.withColumn("_r", rate("p", steps, most)).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
        error = goal - np.array(got[:size])
        off = float(np.linalg.norm(error))
        idle = 0 if off < NEARER * best else idle + 1
        if off < best:
            best, kept = off, len(steps)
        if off <= CLOSE * max(1.0, goal.sum()) or idle >= PATIENCE:
            return steps[:kept]
        curve = np.zeros((size, size))
        curve[np.triu_indices(size)] = got[size:]
        curve = np.maximum(curve, curve.T)
        scale = max(curve.max(), 1.0)
        steps.append(np.linalg.lstsq(curve / scale + damping * np.eye(size), error / scale, rcond=None)[0].tolist())
        damping *= FADE


def targets_for(natural: list[float], names: tuple[str, ...], weights: dict[str, float], anchor: str, anchor_rate: float) -> list[float]:
    total = anchor_rate * natural[names.index(anchor)] / weights[anchor]
    return [total * weights[d] if d in weights else natural[i] for i, d in enumerate(names)]


def copies(r: Column, key: Column, seed: int = 11) -> Column:
    """Whole copies whose mean is the rate."""
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(r + draw).cast("long")


def fit_model(docs: DataFrame, labels: DataFrame) -> Domains:
    model = fit_domains(labelled_sample(docs, labels, DOMAIN_SQL, TRAIN_ROWS, TRAIN_CHARS))
    release_memory()
    return model


def _steps(members: DataFrame, model: Domains, weights: dict[str, float], most: float | None) -> list[list[float]]:
    natural = members.agg(*[F.sum(F.col("n") * F.col("p")[d]).alias(f"s{d}") for d in range(len(model.names))]).first()
    return fit_rates(members, targets_for([x or 0.0 for x in natural], model.names, weights, ANCHOR, ANCHOR_RATE), most)


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))))


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, most: float | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, a posterior per domain, rate, copies."""
    model = fit_model(docs, labels)
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("_key"), membership(model, F.col("text")).alias("_m"))
    members = stored(made.select("doc_id", "_key", "_m.n", "_m.p"), "members")
    rows = members.withColumn("rate", rate("p", _steps(members, model, weights or TARGETS, most), most))
    return rows.select(
        "doc_id", F.col("n").alias("n_tokens"), *[F.col("p")[d].alias(f"p_{x}") for d, x in enumerate(model.names)], "rate", copies(F.col("rate"), F.col("_key")).alias("copies")
    )


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, most: float | None = None) -> DataFrame:
    """``docs`` with each row as often as its copies say, all columns kept; every text is scored once."""
    model = fit_model(docs, labels)
    names = docs.columns
    made = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), _key().alias("_key"), membership(model, F.col("text")).alias("_m"))
    scored = stored(made.select("_row", "_key", "_m.n", "_m.p"), "scored", "zstd")
    steps = _steps(scored.select("n", "p"), model, weights or TARGETS, most)
    rows = scored.select("_row", copies(rate("p", steps, most), F.col("_key")).alias("_n")).filter("_n > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select("_row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
