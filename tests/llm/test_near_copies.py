"""Near copies against brute force."""

import math
import random
from collections import Counter
from functools import cache

import numpy as np
import pytest

from burdenflow.llm import near_copies
from burdenflow.llm.components import components

SCHEMA = "doc_id long, text string, source string, key string, bucket int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "s", "k", 0) for i, t in rows], SCHEMA).repartition(5)


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def shingle_weights(text):
    words = (text or "").lower().split()
    found = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else {}
    return {k: 1 + math.log(n) for k, n in found.items()}


def probability(x, y):
    """Probability Jaccard similarity by its definition."""
    names = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in names) for i in x.keys() & y.keys())


def brute(rows):
    """Smallest doc_id of the class of every row, links being either similarity of 0.8 or more or equal texts."""
    texts = sorted({t or "" for _, t in rows})
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))
    weights = [shingle_weights(t) for t in texts]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            alike = shared and shared >= 0.8 * len(sets[i] | sets[j]) - 1e-9
            # without repeats the similarities are one; few shared shingles leave no room for 0.8 with weights below 6
            repeats = shared > 0.1 * len(sets[i]) and max(max(w.values()) for w in (weights[i], weights[j])) > 1
            if alike or (repeats and probability(weights[i], weights[j]) >= 0.8 - 1e-9):
                root[find(i)] = find(j)
    ids = {}
    for d, t in rows:
        ids.setdefault(find(texts.index(t or "")), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((d, least[find(texts.index(t or ""))]) for d, t in rows), key=repr)


def words(n):
    return ["w" + str(random.randint(0, 5000)) for _ in range(n)]


def edited(base, rate):
    return " ".join(w if random.random() > rate else "e" + str(random.randint(0, 10**6)) for w in base)


def corpus():
    random.seed(12)
    rows = [(i, " ".join(words(random.randint(1, 80)))) for i in range(1000, 1150)]
    for g in range(12):
        base = words(random.randint(30, 120))
        rows += [(2000 + 50 * g + k, edited(base, random.choice([0, 0.005, 0.02, 0.06]))) for k in range(random.randint(2, 12))]
    base = words(100)  # one large group whose copies are near to the base rather than to each other
    rows += [(5000 + k, edited(base, random.choice([0.002, 0.01, 0.02, 0.03, 0.05]))) for k in range(150)]
    common = " ".join(words(40))  # a passage that many texts share
    rows += [(6000 + k, common + " " + " ".join(words(random.randint(10, 200)))) for k in range(40)]
    for g in range(25):  # passages that repeat: alike by weight though not as sets, as sets though not by weight, or both
        passage, rest = words(random.randint(10, 25)), words(random.randint(0, 40))
        for k in range(4):
            tail = edited(rest, random.choice([0, 0.03, 0.3]))
            rows.append((9000 + 10 * g + k, " ".join(passage * random.choice([1, 4, 5, 30])) + " " + tail))
    base = words(12) * 25  # a large group whose members share a repeating passage with each other and little else
    rows += [(9500 + k, " ".join([*base, *words(random.randint(2, 9))])) for k in range(60)]
    rows += [(7000, "Some Text here"), (7001, "some text HERE"), (7002, "some text"), (7003, "some text"), (7004, "x " * 3000), (7005, "x " * 2999)]
    return rows + [(8000, None), (8001, ""), (8002, " \n"), (None, "some text"), (None, "alone"), (8003, "y " * 40 + "z"), (7003, "some text")]


@cache
def brute_corpus():
    return brute(corpus())


@pytest.mark.parametrize("tile", [512, 16])
def test_classes_are_those_of_brute_force(spark, tile):
    rows = corpus()
    got = near_copies.class_members(make(spark, rows), tile=tile).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == brute_corpus()


def test_one_row_of_each_class_stays(spark):
    rows = corpus()
    docs = make(spark, rows)
    kept = near_copies.without_near_copies(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id for r in kept.collect()), key=repr)
    want = sorted({c for _, c in brute_corpus()}, key=repr)
    assert got == want


def test_empty_table(spark):
    assert near_copies.class_members(make(spark, [])).count() == 0
    assert near_copies.without_near_copies(make(spark, [])).count() == 0


def test_registers_agree_as_often_as_probability_jaccard_says():
    draw = np.random.default_rng(4)
    for _ in range(4):
        names = draw.integers(0, 1 << 63, 60).astype(np.uint64)
        a = (np.sort(names[:45]), draw.integers(1, 9, 45))
        b = (np.sort(names[15:]), draw.integers(1, 9, 45))
        rows = near_copies.sketches([a, b, a], 4000)
        assert (rows[0] == rows[2]).all()
        wa, wb = (dict(zip(h.tolist(), 1 + np.log(c))) for h, c in (a, b))
        want = sum(1 / sum(max(wa.get(j, 0) / wa[i], wb.get(j, 0) / wb[i]) for j in {*wa, *wb}) for i in wa.keys() & wb.keys())
        assert abs((rows[0] == rows[1]).mean() - want) < 0.04


def test_unequal_repeats_do_not_part_near_copies(spark):
    # a passage stands once in one text and twenty or a hundred times in the other; the set similarity is 0.8 or more
    random.seed(21)
    rows, alike = [], 0
    for g in range(300):
        passage, rest = words(60), words(240)
        left, right = passage + rest, passage * (20 if g % 2 else 100) + rest
        for place in random.sample(range(len(right) - 235, len(right)), 3 + g % 2 * 2):
            right[place] = f"edit{g}x{place}"
        rows += [(2 * g, " ".join(left)), (2 * g + 1, " ".join(right))]
        a, b = (shingle_set(t) for _, t in rows[-2:])
        assert 0.8 <= len(a & b) / len(a | b)
    got = {r.doc_id: set(r.bands) for r in near_copies.buckets(make(spark, rows), 5, near_copies.BANDS, near_copies.ROWS).collect()}
    missed = sum(not got[2 * g] & got[2 * g + 1] for g in range(300))
    assert missed <= 1


def test_probability_jaccard_is_that_of_its_definition():
    draw = random.Random(31)
    for _ in range(60):
        x, y = ({draw.randint(0, 25): 1 + math.log(draw.randint(1, 30)) for _ in range(draw.randint(1, 20))} for _ in "ab")
        arrays = [np.array(f(d), t) for d in (x, y) for f, t in ((sorted, np.uint64), (lambda d: [d[k] for k in sorted(d)], float))]
        assert near_copies.probability_jaccard(*arrays) == pytest.approx(probability(x, y), abs=1e-12)
    same = np.arange(9, dtype=np.uint64)
    assert near_copies.probability_jaccard(same, np.ones(9), same[3:], np.ones(6)) == pytest.approx(6 / 9)


def test_both_kinds_of_links_occur_in_the_corpus():
    rows = [t for d, t in corpus() if d and 9000 <= d < 9600]
    pairs = [(a, b) for n, a in enumerate(rows) for b in rows[:n]]
    kinds = Counter()
    for a, b in pairs:
        x, y = shingle_set(a), shingle_set(b)
        if len(x & y) > 0.1 * len(x):
            kinds[len(x & y) >= 0.8 * len(x | y), probability(shingle_weights(a), shingle_weights(b)) >= 0.8] += 1
    assert min(kinds[True, False], kinds[False, True], kinds[True, True]) > 5


def test_weighted_near_copies_share_a_bucket(spark):
    # alike by weight, with a set similarity below 0.8
    random.seed(41)
    rows, alike = [], []
    for g in range(300):
        passage, rest = words(60), words(20)
        left, right = passage * 20 + rest, passage * 20 + words(20)
        rows += [(2 * g, " ".join(left)), (2 * g + 1, " ".join(right))]
        a, b = (shingle_set(t) for _, t in rows[-2:])
        alike.append(probability(*(shingle_weights(t) for _, t in rows[-2:])))
        assert len(a & b) / len(a | b) < 0.8 <= alike[-1]
    got = {r.doc_id: set(r.bands) for r in near_copies.buckets(make(spark, rows), 5, near_copies.BANDS, near_copies.ROWS).collect()}
    assert sum(not got[2 * g] & got[2 * g + 1] for g in range(300)) <= 1


def test_leader_is_dealt_out_to_parts(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SHARE", 8)
    rows = corpus()
    got = near_copies.class_members(make(spark, rows)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == brute_corpus()


def test_similarities_of_bounded_sets():
    random.seed(9)
    sets = [np.array(sorted(random.sample(range(30), random.randint(1, 20))), np.uint64) for _ in range(25)]
    got = near_copies.similarities(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == pytest.approx(len({*a} & {*b}) / len({*a} | {*b}), abs=1e-5)


def test_components_of_paths_and_stars(spark):
    random.seed(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    random.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 140)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
