"""Quality scores: held-out accuracy on made-up texts, features against plain counts, odd inputs."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from burdenflow.llm import quality

DOCS = "doc_id long, text string, _score string, label int, source string"
LABELS = "doc_id long, quality int, toxic int"


def texts(n):
    random.seed(5)
    out = []
    for i in range(n):
        words = ["".join(random.choices("abcdefghij", k=random.randint(2, 9))) for _ in range(random.randint(20, 120))]
        good = random.random() < 0.8
        if not good:
            kind = random.randint(0, 2)
            words = [w.upper() + "!!" for w in words] if kind == 0 else words[:3] * 40 if kind == 1 else [w + random.choice(["***", "$$$"]) for w in words]
        out.append((i, " ".join(words) + ".", int(good)))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 5, "s") for i, t, _ in rows], DOCS).repartition(4)
    return docs, spark.createDataFrame([(i, y, 0) for i, _, y in rows if i is not None], LABELS)


def held_out(doc_id, folds=4, held=2):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == held


def test_held_out_documents_are_told_apart(spark):
    rows = texts(800)
    docs, labels = frames(spark, rows)
    got = quality.rank_quality(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == 800 and all(r.held_out == held_out(r.doc_id) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    unseen = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in unseen]) > 0.97
    kept = quality.of_quality(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_reruns_agree(spark):
    docs, labels = frames(spark, texts(200))
    first = sorted(map(tuple, quality.rank_quality(docs, labels).collect()))
    assert first == sorted(map(tuple, quality.rank_quality(docs.repartition(7), labels).collect()))


def test_held_out_labels_are_never_read(spark):
    rows = texts(300)
    docs, labels = frames(spark, rows)
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, quality.rank_quality(docs, labels).collect())) == sorted(map(tuple, quality.rank_quality(docs, turned).collect()))


def test_nulls_empty_and_long_texts_and_repeated_rows(spark):
    rows = texts(120) + [(500, None, 1), (501, "", 0), (502, "z" * 200_000, 0), (503, " \n\t", 0), (None, "a b", 1)] + texts(120)[:5]
    docs, labels = frames(spark, rows)
    labels = labels.union(spark.createDataFrame([(None, 1, 1), (900, None, None)], LABELS))
    got = quality.rank_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(r.score is not None for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(v) == 1 for v in by_id.values()) and by_id[500] == by_id[501]


@pytest.mark.parametrize("label", [None, 0, 1])
def test_without_preferences_all_stay(spark, label):
    docs, _ = frames(spark, texts(30))
    labels = spark.createDataFrame([] if label is None else [(i, label, 0) for i in range(30)], LABELS)
    assert {(r.score, r.predicted) for r in quality.rank_quality(docs, labels).collect()} == {(0.7, 1)}


def test_empty_table(spark):
    docs, labels = frames(spark, texts(20))
    assert quality.rank_quality(docs.limit(0), labels).count() == 0


def test_features_count_what_they_say():
    named = dict(zip(quality.NAMES, quality.features("AB cd!!\n$$ 12\ncd!!\ncd!!")))
    assert named["capitals"] == pytest.approx(2 / 23) and named["lines"] == pytest.approx(3 / 23)
    assert named["repeated_lines"] == pytest.approx(1 / 4) and named["distinct"] == pytest.approx(4 / 6)
    assert named["bare"] == pytest.approx(2 / 6) and named["commonest"] == pytest.approx(3 / 6)
    assert len(quality.features(None)) == len(quality.NAMES)


def test_logistic_is_at_its_optimum():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(400, 3))
    y = (draw.random(400) < 1 / (1 + np.exp(-x @ [1.0, -2.0, 0.5]))).astype(float)
    w = quality.logistic(x, y, 1e-3)
    gradient = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / 400 + 1e-3 * w
    assert np.abs(gradient).max() < 1e-6


def test_threshold_is_the_quantile_of_the_scores():
    draw = np.random.default_rng(1)
    labels = (draw.random(500) < 0.7).astype(int)
    rows = draw.normal(size=(500, len(quality.NAMES))) + labels[:, None] * 0.3
    ranker = quality.learn(rows, labels, 0.7, pairs=2000)
    assert (ranker.scores(rows) >= 0.7).sum() == labels.sum()
    order = np.argsort(ranker.latent(rows))
    assert (np.diff(ranker.scores(rows)[order]) >= 0).all()


def plain_features(text):
    """The features word by word and byte by byte, as the names say."""
    text = text or ""
    raw, words, lines = list(text.encode("utf-8", "replace")), text.split(), text.split("\n")
    stops = [ord(x) for x in ".,;:?'\"-()"]
    letter = lambda x: x.isalpha() or x.isalnum() and not x.isdecimal() and x != "_"
    kinds = [
        lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57, lambda b: b in stops, lambda b: b == 33,
        lambda b: 33 <= b < 127 and not chr(b).isalnum() and b not in stops and b != 33, lambda b: b in (9, 10, 11, 12, 13, 32), lambda b: b == 10,
    ]
    of_bytes, of_words = max(1, len(raw)), max(1, len(words))
    return [
        *(sum(map(kind, raw)) / of_bytes for kind in kinds),
        math.log(1 + len(raw)), math.log(1 + len(words)), len(raw) / of_words, len(set(words)) / of_words,
        max((words.count(w) for w in set(words)), default=0) / of_words,
        len(zlib.compress(bytes(raw), 1)) / (len(raw) + 12),
        sum(not any(map(letter, w)) for w in words) / of_words,
        sum(w.isalpha() and len(w) <= 3 for w in words) / of_words,
        1 - len(set(lines)) / len(lines),
        sum(not w[-1].isalnum() and ord(w[-1]) not in stops for w in words) / of_words,
        math.log(1 + max(map(len, words), default=0)),
    ]


def best_weights(x, y, penalty):
    """The optimum of the penalised logistic loss: Newton steps, halved until the loss falls."""
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (x @ w)).mean() + penalty * w @ w / 2
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w)))
        gradient = x.T @ (p - y) / len(y) + penalty * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) / len(y) + penalty * np.eye(len(w)), gradient)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-9:
            size /= 2
        w = w - size * step
        if np.abs(gradient).max() < 1e-10:
            break
    return w


def brute_scores(docs, labels, folds, held, keep_from):
    """Scores of all documents (doc_id, text): features, preferences and both fits formed anew."""
    known = {}
    for doc_id, label in labels:
        if label is not None:
            known[doc_id] = max(label, known.get(doc_id, 0))
    train = sorted((known[i], plain_features(t)) for i, t in docs if i in known and zlib.crc32(str(i).encode()) % folds != held)
    y, rows = np.array([label for label, _ in train]), np.array([f for _, f in train])
    middle, scale = np.median(rows, axis=0), rows.std(axis=0) + 1e-9
    z = (rows - middle) / scale
    hinges = [np.quantile(z, q, axis=0) for q in (0.02, 0.1, 0.5, 0.9, 0.98)]

    def wide(f):
        near = np.clip((f - middle) / scale, -8, 8)
        return np.hstack([near] + [np.maximum(0, near - h) for h in hinges])

    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(quality.SEED)  # the pairs are a seeded choice
    pairs = list(zip(draw.choice(good, quality.PAIRS), draw.choice(bad, quality.PAIRS)))
    x = wide(rows)
    gaps = np.array([x[b] - x[a] if k % 2 else x[a] - x[b] for k, (a, b) in enumerate(pairs)])
    weights = best_weights(gaps, np.array([0.0 if k % 2 else 1.0 for k in range(len(pairs))]), 1e-3)
    latent = x @ weights
    ordered = sorted(latent)
    cut = (ordered[len(bad) - 1] + ordered[len(bad)]) / 2
    slope = max(1e-3, best_weights(np.stack([latent - cut, np.ones(len(latent))], axis=1), y.astype(float), 1e-4)[0])
    odds = math.log(keep_from / (1 - keep_from))
    return {i: 1 / (1 + math.exp(-max(-30, min(30, slope * (wide(np.array(plain_features(t))) @ weights - cut) + odds)))) for i, t in docs}
