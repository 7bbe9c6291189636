"""Fingerprints and their pairs against brute force."""

import hashlib
import random
import re

import pytest

from burdenflow.llm import spots

SCHEMA = "doc_id long, text string, own string, part int"
ANCHORS = ["the", "of", "à"]


def make(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(4)


def chains(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    out, now = set(), []
    for w in [*words, "the"]:
        if w in ANCHORS:
            out.add(" ".join(now[:3]))
            now = []
        else:
            now.append(w)
    return out - {""} or {" ".join(words)} - {""}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for n, (i, t) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        own, new = chains(t), chains(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), len(own), len(new), round(jaccard(own, new), 9), round(jaccard(own, chains(after)), 9)))
    return sorted(out, key=repr)


def mine(df):
    return sorted(
        ((r.doc_id, r.n_chars, r.edited_sha256, len(r.fingerprint) // 8, len(r.edited_fingerprint) // 8, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()),
        key=repr,
    )


WORDS = "the of à cat dog sun moon rain élan nord ost süd west x9 7".split()


def test_fingerprints_of_texts_and_edited_texts(spark):
    random.seed(1)
    rows = [(i * 7, random.choice([" ", ", ", "\n"]).join(random.choices(WORDS, k=random.randint(0, 60)))) for i in range(150)]
    rows += [(7, rows[3][1]), (7, "zz"), (None, "the cat"), (None, None), (9, None), (11, ""), (13, "!!"), (15, "😀é " * 2000 + "the end of")]
    docs = make(spark, rows)
    assert mine(spots.fingerprints(docs, ANCHORS)) == brute(rows)
    by_text = {}
    for r in spots.fingerprints(docs, ANCHORS).join(docs.select("doc_id", "text"), "doc_id").collect():
        if r.doc_id != 7:
            by_text.setdefault(r.text or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_one_document_and_none(spark):
    assert mine(spots.fingerprints(make(spark, [(5, "the cat of rain")]), ANCHORS)) == brute([(5, "the cat of rain")])
    assert spots.fingerprints(make(spark, [])).count() == 0
    assert mine(spots.fingerprints(make(spark, [(1, "")]))) == brute([(1, "")])


def test_repeated_rows(spark):
    rows = [(1, "the cat of rain")] * 40 + [(2, "sun of moon")] * 3
    assert mine(spots.fingerprints(make(spark, rows), ANCHORS)) == brute(rows)


def test_long_runs_of_anchors_and_signs(spark):
    rows = [(1, "the of " * 60_000), (2, "!?" * 60_000 + "cat"), (3, "the " * 50_000 + "cat " * 50_000)]
    assert mine(spots.fingerprints(make(spark, rows), ANCHORS)) == brute(rows)


def test_anchors_are_the_commonest_short_words(spark):
    rows = [(1, "The, the THE of of elephants elephants elephants elephants"), (2, None), (3, "9 9 9 9 9 9")]
    assert spots.anchors_of(make(spark, rows), most=2) == ["the", "of"]


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_pairs_of_like_fingerprints(spark, least):
    random.seed(int(10 * least))
    rows = []
    for i in range(40):
        base = [random.choice(ANCHORS) + " " + "".join(random.choices("abcde", k=4)) for _ in range(random.randint(1, 12))]
        for j in range(4):
            changed = [b if random.random() < 0.9 else "the new" + str(random.randint(0, 50)) for b in base]
            rows.append((10 * i + j, " ".join(changed)))
    sets = {}
    for _, t in rows:
        sets.setdefault(frozenset(chains(t)), t)
    want = sorted(round(jaccard(a, b), 9) for a in sets for b in sets if a != b and jaccard(a, b) >= least - 1e-12)[::2]
    got = spots.near_fingerprints(make(spark, rows), least, ANCHORS).collect()
    assert sorted(round(r.likeness, 9) for r in got) == want and all(r.a < r.b for r in got)


def test_native_plan(spark):
    plan = spots.fingerprints(make(spark, [(1, "the cat")]), ANCHORS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
