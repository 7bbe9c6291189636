"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from burdenflow.llm import ranked
from burdenflow.llm.ranked import Postings, rank, search_block, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(doc_id, Counter(split(text))) for doc_id, text in docs]
    n_all, l_all = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n_all // max(l_all, 1)
            score = sum(n * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, n in Counter(split(text)).items() if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["Été", "Wort", "x1", "the", "THE", "of", "naïve", "日本", "a", *(f"w{i}" for i in range(60))]
    docs = [(i, rng.choice([" ", "-", "_", "\n"]).join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(60)))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(40)] + [(3, docs[3][1]), (None, docs[5][1]), (None, None), (-7, ""), (-8, "... --")]
    items = [(i, docs[rng.randrange(n)][1]) for i in range(15)] + [(99, None), (100, ""), (101, "unheard"), (102, "the the the x1"), (None, "the of"), (102, "the the the x1")]
    return docs, items


def test_terms():
    text = "Ünder_score [x]{y}~z @`^ 1.5\x00\x7fQ é日本 k"
    assert [t.decode() for t in terms_of(text)] == split(text)
    assert terms_of(None) == []


@pytest.mark.parametrize("block", [7, 4096])
def test_against_brute_force(spark, monkeypatch, block):
    docs, items = corpus(1)
    frame = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS block", "true AS lead", "'x' AS key", "0 AS rank").repartition(5)
    asked = spark.createDataFrame(items, ITEMS).selectExpr("*", "2L AS score", "'y' AS item", "0 AS doc_id")
    found = rank(frame, asked, "item_id", 20, documents=block)
    assert got(found) == brute(docs, items, 20)


def test_batches_of_queries(spark, monkeypatch):
    docs, items = corpus(2, 120)
    monkeypatch.setattr(ranked, "BATCH_TERMS", 40)
    assert got(rank(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), "item_id", 3, documents=10)) == brute(docs, items, 3)


def test_empty(spark):
    docs, items = corpus(3, 20)
    assert got(rank(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS), "item_id", 3)) == []
    assert got(rank(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS), "item_id", 3)) == []


def test_long_text(spark):
    docs = [(1, "aa bb " * 500_000), (2, "aa"), (3, "bb"), (4, "cc dd")]
    assert got(rank(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, "aa bb")], ITEMS), "item_id", 2)) == brute(docs, [(1, "aa bb")], 2)


@pytest.mark.parametrize("seed", range(5))
def test_blocks(seed):
    """Intervals and bounds give what scores of all documents give, with ties and floors."""
    rng = np.random.default_rng(seed)
    n, t = 500, 6
    lists = [np.sort(rng.choice(n, rng.integers(1, n), replace=False)) for _ in range(t)]
    impacts = [rng.integers(1, 8, len(x)) for x in lists]
    postings = Postings(np.array([len(x) for x in lists]), np.concatenate(lists), np.concatenate(impacts), n)
    asked, repeats = np.array([0, 2, 3, 5]), np.array([1, 3, 1, 2])
    total = np.zeros(n, int)
    for a, r in zip(asked, repeats):
        total[lists[a]] += r * impacts[a]
    order = np.lexsort((np.arange(n), -total))
    for k, floor in ((1, 0), (20, 0), (20, int(total.max()) - 2), (600, 0)):
        expected = [(int(total[d]), int(d)) for d in order[:k] if total[d] >= max(floor, 1)]
        assert search_block(postings, asked, repeats, k, floor) == expected
    assert search_block(postings, asked[:0], repeats[:0], 3, 0) == []
