"""Text quality by positive-unlabelled learning with the non-negative risk.

Trusted positives are rows labelled 1; unlabelled web text is the documents at large. Labels 0 are never used. With the class prior pi of the
unlabelled text, a small network over text statistics minimises
``pi * R_pos(+) + max(0, R_unl(-) - pi * R_pos(-))`` (sigmoid loss, Adam, mini-batches); where the bracket turns negative
the step goes against it, which keeps a flexible model from over-fitting the positives.

The prior is estimated from positives and unlabelled text alone: a first network, trained with a prior of one half, scores
rows that it has not seen; above any score, unlabelled text holds at least pi times the share that positives have there, so
pi is the smallest ratio of the two shares, over thresholds that at least half of the positives pass (``LEAST_PASSING``). The
outputs of the second network become probabilities by a sigmoid that minimises the unbiased logistic risk
``mean_unl softplus(z) - pi * mean_pos z`` on held-back rows, which is convex and needs no negatives either.

The classifier is fitted on bounded samples, chosen by a hash of doc_id: about ``SAMPLE`` labelled positives and
``2 * SAMPLE`` unlabelled rows of the training fold (the second sample is of documents, not of labels). Executors compute the statistics; only those rows of about thirty numbers are
collected. Scoring is one pass over all texts without a shuffle.

Defined results: null text is empty and is scored like any text; very long texts are read whole; with no positive labels to
learn from, or an empty table of documents, every score is 0.5; several labels for a document count as several rows;
repeated documents each give a row, equal texts equal scores; a null doc_id stays null; other columns are ignored, but for
``score`` and ``predicted``, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import portions, texts

SAMPLE = 4000
#: Thresholds that fewer of the positives pass say little about the prior.
LEAST_PASSING = 0.5
THRESHOLD = 0.3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = "!?|*&%$#@<>{}=+~^_/\\"


def statistics(text: str) -> list[float]:
    """Shares and logarithms that describe form, not topic or language; bounded, and zeros for an empty text."""
    n = len(text)
    if not n:
        return [0.0] * (16 + len(_MARKS))
    tokens = text.split()
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if x]
    k, w = max(1, len(tokens)), max(1, len(words))
    counts = Counter(tokens)
    lowered = Counter(map(str.lower, words))
    pairs = len(set(zip(tokens, tokens[1:], strict=False)))
    same = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    marks = Counter(text)
    return [
        math.log1p(n), math.log1p(k), sum(map(len, words)) / n, len(counts) / k, pairs / k, same / k, max(counts.values(), default=0) / k,
        sum(c for _, c in lowered.most_common(10)) / w, sum(x.isupper() and len(x) > 1 for x in words) / w, sum(x.istitle() for x in words) / w,
        sum(map(len, words)) / w / 10, sum(not x[-1].isalnum() for x in tokens) / k, sum(not any(map(str.isalpha, x[:4])) for x in tokens) / k,
        1 - len(set(lines)) / max(1, len(lines)), len(lines) / k, sum(marks.get(d, 0) for d in "0123456789") / n,
        *(math.sqrt(marks.get(m, 0) / n) for m in _MARKS),
    ]


class PuNetwork:
    """One hidden layer; trained on the non-negative positive-unlabelled risk."""

    def __init__(self, positives: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 16, epochs: int = 40, batch: int = 512, rate: float = 5e-3, seed: int = 3):
        both = np.concatenate([positives, unlabelled])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-3
        self.slope, self.shift, self.prior = 1.0, 0.0, prior
        r = np.random.default_rng(seed)
        self.w = [r.normal(0, 1 / math.sqrt(both.shape[1]), (both.shape[1], hidden)), np.zeros(hidden), r.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)]
        p, u = self._scaled(positives), self._scaled(unlabelled)
        first, second = [np.zeros_like(x) for x in self.w], [np.zeros_like(x) for x in self.w]
        steps = max(1, len(u) // batch)
        for t in range(epochs * steps):
            xp, xu = p[r.integers(0, len(p), batch)], u[r.integers(0, len(u), batch)]
            for i, g in enumerate(self._step(xp, xu)):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                self.w[i] = self.w[i] - rate * (first[i] / (1 - 0.9 ** (t + 1))) / (np.sqrt(second[i] / (1 - 0.999 ** (t + 1))) + 1e-8)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.w[0] + self.w[1])
        return h, h @ self.w[2] + self.w[3]

    def _step(self, xp: np.ndarray, xu: np.ndarray) -> list[np.ndarray]:
        """Gradient of the risk, or, where the estimated negative risk is below zero, the step that raises it."""
        hp, zp = self._forward(xp)
        hu, zu = self._forward(xu)
        sp, su = 1 / (1 + np.exp(-np.clip(zp, -50, 50))), 1 / (1 + np.exp(-np.clip(zu, -50, 50)))
        dp, du = sp * (1 - sp), su * (1 - su)
        negative_risk = su.mean() - self.prior * sp.mean()
        gp, gu = self.prior * dp / len(xp), du / len(xu)
        outer = [(xp, hp, -gp - gp), (xu, hu, gu)] if negative_risk >= 0 else [(xp, hp, gp), (xu, hu, -gu)]
        out = [np.zeros_like(x) for x in self.w]
        for x, h, d in outer:
            back = np.outer(d, self.w[2]) * (1 - h * h)
            for i, g in enumerate((x.T @ back, back.sum(axis=0), h.T @ d, d.sum(keepdims=True))):
                out[i] += g
        return [g + 1e-5 * x for g, x in zip(out, self.w, strict=True)]

    def calibrate(self, positives: np.ndarray, unlabelled: np.ndarray, steps: int = 60) -> PuNetwork:
        """The sigmoid of the least unbiased logistic risk on rows that were not learned from, by damped Newton steps; a small
        penalty holds it near the plain one where the two kinds of rows do not overlap."""
        zp, zu = self.raw(positives), self.raw(unlabelled)
        pull = self.prior * np.array([zp.mean(), 1.0])
        rows, w = np.stack([zu, np.ones(len(zu))], axis=1), np.array([1.0, 0.0])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(rows @ w, -50, 50)))
            gradient = rows.T @ p / len(rows) - pull + 1e-2 * (w - [1.0, 0.0])
            curve = (rows * (p * (1 - p))[:, None]).T @ rows / len(rows) + 1e-2 * np.eye(2)
            w = w - np.clip(np.linalg.solve(curve, gradient), -1, 1)
        self.slope, self.shift = float(max(w[0], 1e-3)), float(w[1])
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.raw_scaled(self._scaled(x))

    def raw_scaled(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self._forward(self._scaled(x))[1] + self.shift, -50, 50)))


def estimated_prior(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in unlabelled rows, from the scores of both: the least ratio of the shares that pass a threshold."""
    at = np.quantile(positives, np.linspace(0, 1 - LEAST_PASSING, 26))
    passing = [1 - np.searchsorted(np.sort(x), at, side="left") / len(x) for x in (positives, unlabelled)]
    return float(np.clip((passing[1] / passing[0]).min(), 0.01, 0.99))


def learned(positives: np.ndarray, unlabelled: np.ndarray) -> PuNetwork:
    """The calibrated network; a third of the rows is held back, for the prior and the calibration."""
    folds = [(x[np.arange(len(x)) % 3 > 0], x[::3]) for x in (positives, unlabelled)]
    (p, held_p), (u, held_u) = ((own if len(own) else x, held) for (own, held), x in zip(folds, (positives, unlabelled), strict=True))
    first = PuNetwork(p, u, 0.5)
    prior = estimated_prior(first.raw(held_p), first.raw(held_u))
    return PuNetwork(p, u, prior).calibrate(held_p, held_u)


def _stat_rows(rows: DataFrame) -> np.ndarray:
    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            yield pa.RecordBatch.from_arrays([pa.array([statistics(t) for t in texts(b.column("text"))], pa.list_(pa.float64()))], names=["x"])

    got = rows.select("text").mapInArrow(stats, "x array<double>").toArrow()
    x = got.column("x").combine_chunks()
    table = np.asarray(x.flatten()).reshape(got.num_rows, -1) if got.num_rows else np.empty((0, 1))
    return table[np.lexsort(table.T)] if len(table) else table  # rows come in any order, and the network must not depend on it


def _sampled(rows: DataFrame, total: int, most: int, seed: int) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < F.lit(int(min(1.0, most / max(1, total)) * (1 << 20))))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> PuNetwork | None:
    """A network from docs(doc_id, text) and labels(doc_id, quality), of which only rows where ``learn`` holds are read."""
    trusted = labels.where(learn & (F.col("quality") == 1)).select("doc_id")
    there = docs.where(learn).select("doc_id", "text")
    known = trusted.transform(_sampled, trusted.count(), sample, 1)
    positives = _stat_rows(there.join(known, "doc_id").select("text"))
    unlabelled = _stat_rows(there.transform(_sampled, there.count(), 2 * sample, 3))
    return learned(positives, unlabelled) if len(positives) and len(unlabelled) else None


def score(docs: DataFrame, network: PuNetwork | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs without text, with score (0 to 1) and predicted (1 if score >= threshold), which replace columns of these names."""
    held = docs.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        if not len(text):
            return pa.array([], pa.float64())
        if held.value is None:
            return pa.array([0.5] * len(text), pa.float64())
        return pa.array(held.value.probability(np.array([statistics(t) for t in texts(text)])), pa.float64())

    rest = [c for c in docs.columns if c not in ("text", "score", "predicted")]
    return docs.select(*rest, scored("text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
