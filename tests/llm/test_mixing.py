"""Mixing against water filling by hand and exhaustive subset sums."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from burdenflow.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, n_chars int"


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Share by weight; take the excess of those above their cap and share it again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full, out = share * sum(sizes.values()), {}, {}
    while True:
        free = [s for s in names if s not in full]
        spare = left - sum(full.values())
        out = {s: spare * weight[s] / sum(weight[t] for t in free) for s in free}
        over = {s: most * sizes[s] for s in free if out[s] > most * sizes[s]}
        if not over:
            return out | full
        full |= over


def make(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 3) for i, t, s in rows], SCHEMA).repartition(5)


def check(rows, got, off=0):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = targets(sizes), {}
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 2
        assert r.size or not r.copies
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    for s, n in taken.items():
        assert abs(n - want[s]) <= off + 0.5, (s, n, want[s])


def test_targets_are_met_and_reruns_agree(spark):
    random.seed(3)
    rows = [(i, " ".join("w" * random.choice([1, 1, 2, 3, 5, 8, 40, 300])), random.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(4000)]
    rows = [(i, "w " * random.choice([1, 2, 3, 5, 8, 40, 300]), s) for i, _, s in rows]
    got = mixing.mix(make(spark, rows)).collect()
    check(rows, got)
    again = mixing.mix(make(spark, rows[::-1])).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)


def test_one_size_shared_by_all_and_repeated_rows(spark):
    rows = [(i // 7, "one two three", "hot" if i % 3 else "cold") for i in range(3000)]
    check(rows, mixing.mix(make(spark, rows)).collect(), off=3)
    rows = [(1, "one two", "s")] * 50 + [(2, "one two", "s")] * 49
    check(rows, mixing.mix(make(spark, rows)).collect(), off=2)


def test_nulls_empty_and_long_texts(spark):
    rows = [(None, "a b", "x"), (1, None, "x"), (2, "", None), (3, "w " * 60000, "y"), (4, "c\x85d \x1fe", "y"), (5, "q", None)]
    got = mixing.mix(make(spark, rows)).collect()
    assert {r.doc_id: r.size for r in got} == {None: 2, 1: 0, 2: 0, 3: 60000, 4: 2, 5: 1}
    assert mixing.mix(make(spark, [])).count() == 0
    only = mixing.mix(make(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [r.copies for r in only] == [0, 0]


def test_rows_come_as_often_as_they_are_taken(spark):
    rows = [(i, "w " * (i % 9), "ab"[i % 2]) for i in range(200)]
    docs = make(spark, rows)
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    counted = {r.doc_id: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counted == {k: n for k, n in copies.items() if n}


def test_fit_is_as_near_as_any_choice():
    random.seed(11)
    for _ in range(300):
        sizes = np.array(sorted(random.sample(range(1, 30), 4)))
        counts = np.array([random.randint(1, 3) for _ in sizes])
        budget = random.randint(0, int((sizes * counts).sum()) + 3)
        taken = mixing.fit(sizes, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all()
        # shares come first, so the rest is the best that can be made of what they leave
        total = int((sizes * counts).sum())
        base = counts if budget >= total else np.floor(counts * (budget / total)).astype(int)
        sums = {int((sizes * (base + np.array(c))).sum()) for c in itertools.product(*(range(n + 1) for n in counts - base))}
        assert int((sizes * taken).sum()) == max(x for x in sums if x <= budget)


def test_few_long_documents_fit_exactly():
    sizes, counts = np.array([60_000, 70_000, 100_000]), np.ones(3, int)
    assert mixing.fit(sizes, counts, 130_000).tolist() == [1, 1, 0]
    # more words than are accounted for: the longest go first
    assert mixing.fit(np.array([1, 10]), np.array([30, 30]), 207, last_words=5) @ [1, 10] == 207


def test_columns_with_names_of_the_plan_come_back(spark):
    docs = make(spark, [(i, "w " * (i % 9), "ab"[i % 2]) for i in range(50)]).selectExpr(
        "doc_id", "text", "source", "'keep me' AS size", "1.5 AS target", "'x' AS copies", "array(1) AS source_size", "7 AS _size", "8 AS _draw", "'r' AS row", "'m' AS _mix_more")
    out = mixing.mixed(docs)
    assert out.schema == docs.schema
    assert {tuple(map(str, r)) for r in out.collect()} <= {tuple(map(str, r)) for r in docs.collect()}
    assert out.count() == mixing.mixed(docs.select("doc_id", "text", "source")).count() > 0


def test_many_rows_without_doc_id_are_told_apart(spark):
    rows = [(None, "w " * 5 + str(i), "a") for i in range(40)] + [(1, "x", "b")]
    got = mixing.mix(make(spark, rows)).collect()
    check(rows, got, off=5)
