"""Quality scores learned from preferences between documents, after Bradley and Terry.

A document of label 1 is preferred to one of label 0. The difference of their scores gives the odds of the
preference, so scores are learned from feature differences by logistic loss; a score is a weighted sum of
features of the whole text. Features say how the text is built (letters, signs, capitals, repetition, line and
word lengths), not which words it holds. Each is taken as such and as hinges at quantiles of the sample, so that
too little and too much can both count against a text.

The threshold is the quantile of the sample's scores that leaves as large a share below as has label 0. The
result maps the threshold to `keep_from` and grows with the score by the slope that fits the labels.

Learned from at most `sample` labelled rows and `pairs` preferences among them.
Null texts are empty ones and get a score like any other. A null doc_id counts as the empty text where folds are
formed and has no label. Repeated rows get a result each. Without preferences (no labels, or only one) every
document gets `keep_from`. Other columns are kept out of the features. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burdenflow.llm.labelled import bounded, fold, labels_of, passing
from burdenflow.llm.store import keep

SAMPLE, PAIRS, SEED = 30_000, 20_000, 23
_KINDS = {
    "capitals": bytes(range(65, 91)),
    "digits": bytes(range(48, 58)),
    "stops": b".,;:?'\"-()",
    "marks": b"!",
    "signs": bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?'\"-()!"),
    "spaces": b" \t\n\r\x0b\x0c",
    "lines": b"\n",
}
_LETTERS = re.compile(r"[^\W\d_]")
NAMES = [*_KINDS, "size", "words", "word_length", "distinct", "commonest", "packed", "bare", "short", "repeated_lines", "sign_ends", "longest"]


def features(text: str | None) -> list[float]:
    """Numbers that describe how the whole text is built."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    shares = [(len(raw) - len(raw.translate(None, kind))) / n for kind in _KINDS.values()]
    words = text.split()
    count = max(1, len(words))
    known = Counter(words)
    bare = short = ends = longest = 0
    for word, times in known.items():
        longest = max(longest, len(word))
        if not word[-1].isalnum() and word[-1] not in ".,;:?'\"-)":
            ends += times
        if word.isalpha():
            short += times * (len(word) <= 3)
        elif not _LETTERS.search(word):
            bare += times
    lines = text.split("\n")
    return [
        *shares,
        np.log1p(len(raw)),
        np.log1p(len(words)),
        len(raw) / count,
        len(known) / count,
        max(known.values(), default=0) / count,
        len(zlib.compress(raw, 1)) / (len(raw) + 12),
        bare / count,
        short / count,
        1 - len(set(lines)) / len(lines),
        ends / count,
        np.log1p(longest),
    ]


def feature_rows(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(NAMES))


@dataclass
class Ranker:
    """Scores of feature rows."""

    middle: np.ndarray
    scale: np.ndarray
    hinges: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    keep_from: float

    def latent(self, rows: np.ndarray) -> np.ndarray:
        # a plain sum for each row, so a score doesn't depend on the rows it is computed with
        return (spread(rows, self.middle, self.scale, self.hinges) * self.weights).sum(axis=1)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        even = np.log(self.keep_from / (1 - self.keep_from))
        gap = self.latent(rows) - self.threshold
        out = 1 / (1 + np.exp(-np.clip(self.slope * gap + even, -30, 30)))
        # rounding must not move a score across the threshold
        return np.where(gap >= 0, np.maximum(out, self.keep_from), np.minimum(out, np.nextafter(self.keep_from, 0)))


def spread(rows: np.ndarray, middle: np.ndarray, scale: np.ndarray, hinges: np.ndarray) -> np.ndarray:
    z = np.clip((rows - middle) / scale, -8, 8)
    return np.concatenate([z, *(np.maximum(0, z - h) for h in hinges)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 25, times: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression with squared penalty, by Newton's method; a row counts as often as `times` says."""
    w = np.zeros(x.shape[1])
    share = np.ones(len(y)) if times is None else times / times.mean()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) / len(y) + penalty * w
        step = np.linalg.solve((x.T * (share * p * (1 - p))) @ x / len(y) + penalty * np.eye(len(w)), gradient)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return w


def learn(rows: np.ndarray, labels: np.ndarray, keep_from: float, pairs: int = PAIRS, seed: int = SEED) -> Ranker:
    """Fit the scores to preferences drawn from the labelled rows."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        k = len(NAMES)
        return Ranker(np.zeros(k), np.ones(k), np.zeros((0, k)), np.zeros(k), 0.0, 1.0, keep_from)
    middle, scale = np.median(rows, axis=0), rows.std(axis=0) + 1e-9
    z = (rows - middle) / scale
    hinges = np.quantile(z, [0.02, 0.1, 0.5, 0.9, 0.98], axis=0)
    wide = spread(rows, middle, scale, hinges)
    draw = np.random.default_rng(seed)
    first, second = draw.choice(good, pairs), draw.choice(bad, pairs)
    # one sign for all differences would make the answer constant, so every other pair is turned round
    turn = np.where(np.arange(pairs) % 2, -1.0, 1.0)
    weights = logistic((wide[first] - wide[second]) * turn[:, None], (turn + 1) / 2, 1e-3)
    latent = wide @ weights
    ordered = np.sort(latent)
    threshold = (ordered[len(bad) - 1] + ordered[len(bad)]) / 2
    slope = logistic(np.stack([latent - threshold, np.ones(len(latent))], axis=1), labels, 1e-4)[0]
    return Ranker(middle, scale, hinges, weights, float(threshold), float(max(slope, 1e-3)), keep_from)


def learn_from(docs: DataFrame, labels: DataFrame, train: Column, keep_from: float, sample: int = SAMPLE) -> Ranker:
    """Learn from at most `sample` labelled documents for which the condition holds; only their features come to the driver."""

    def computed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "features": [features(t) for t in batch["text"]]})

    known = docs.select("doc_id").filter(train).distinct().join(labels_of(labels, "quality"), "doc_id")
    ids = keep(bounded(known, sample, SEED), "quality-sample")
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most `sample` pairs of numbers
    held = chosen.select("label", "text").mapInPandas(computed, "label int, features array<double>").collect()
    held.sort()  # the fit must not depend on the order in which rows come
    table = np.array([r["features"] for r in held], float).reshape(-1, len(NAMES))
    return learn(table, np.array([r["label"] for r in held], int), keep_from)


def scored(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id and score of documents doc_id, text."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["doc_id"]].assign(score=ranker.scores(feature_rows(batch["text"])))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(score, "doc_id long, score double")


def rank_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, keep_from: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= keep_from) for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held_out = fold("doc_id", folds) == held
    ranker = learn_from(rows, labels, ~held_out, keep_from)
    out = scored(rows, ranker).select("doc_id", held_out.alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= keep_from).cast("int"))


def of_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, keep_from: float = 0.7) -> DataFrame:
    """The documents whose score reaches keep_from, learned as in rank_quality()."""
    ranker = learn_from(docs, labels, fold("doc_id", folds) != held, keep_from)
    return passing(docs, lambda: lambda texts: ranker.scores(feature_rows(texts)) >= keep_from)
