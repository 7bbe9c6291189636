"""Toxicity scores: held-out accuracy, disguised words, the Viterbi path against all paths."""

import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from burdenflow.llm import toxicity

DOCS = "doc_id long, text string, _score string, label int, half int"
LABELS = "doc_id long, quality int, toxic int"
BAD = ["grumbolt", "snarvik", "plondercast"]
LEET = str.maketrans({"o": "0", "a": "@", "e": "3", "l": "1"})


def texts(n):
    random.seed(8)
    vocabulary = ["".join(random.choices("abdefgilmnorstu", k=random.randint(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        words, toxic = random.choices(vocabulary, k=random.randint(15, 60)), random.random() < 0.25
        if toxic:
            for _ in range(random.randint(1, 3)):
                words.insert(random.randint(0, len(words)), random.choice(BAD) + random.choice(["", "", "s", "ing"]))
        out.append((i, " ".join(words), int(toxic)))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, 1) for i, t, _ in rows], DOCS).repartition(4)
    return docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows if i is not None], LABELS)


@pytest.fixture(scope="module")
def learned(spark):
    rows = texts(900)
    docs, labels = frames(spark, rows)
    return rows, docs, labels, toxicity.learn(docs, labels, toxicity.fold("doc_id", 5) != 0)


def scores(model, some):
    scorer = toxicity.Scorer(model.characters, model.terms)
    return model.scores(np.array([scorer.evidence(t) for t in some]))


def test_held_out_documents_are_told_apart(learned):
    rows, docs, labels, _ = learned
    got = toxicity.score_toxicity(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out]) > 0.98
    kept = toxicity.not_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


@pytest.mark.parametrize(
    "disguise",
    [lambda w: w.translate(LEET), lambda w: " ".join(w), lambda w: ".".join(w), lambda w: w[:2] + w[2] * 5 + w[3:], lambda w: w.upper() + "!!!", lambda w: f"**{w}**"],
)
def test_disguised_words_are_found(learned, disguise):
    rows, _, _, model = learned
    plain = [" ".join(t.split()[:12]) for _, t, y in rows if not y][:60]
    toxic = [f"{t} {disguise(random.choice(BAD))} {t}" for t in plain]
    assert (scores(model, toxic) >= 0.5).mean() > 0.85
    assert (scores(model, plain) < 0.5).all()


@pytest.mark.parametrize(
    "disguise",
    [
        lambda w: w[:2] + w[2] + w[2:],
        lambda w: w[:4] + w[4] + w[4:6] + w[6] + w[6:],
        lambda w: w.translate(str.maketrans("oae", "\u043e\u0430\u0435")),
        lambda w: f"{w[:2]} {w[2:5]} {w[5:6]} {w[6:8]} {w[8:]}".strip(),
    ],
)
def test_light_disguises_are_found(learned, disguise):
    rows, _, _, model = learned
    score = model.scorer()
    plain = [" ".join(t.split()[:12]) for _, t, y in rows if not y][:60]
    toxic = [f"{t} {disguise(BAD[i % 2])} {t}" for i, t in enumerate(plain)]
    assert (score(toxic) >= 0.5).mean() > 0.85
    assert (score(plain) < 0.5).all()


def test_common_words_stay_as_they_are(spark):
    texts = ["see the book and the little letter of all good people", "\u043e\u043d\u0430 \u0441\u0435\u043b\u0430 \u0440\u043e\u0441\u0430"] * 5
    docs = spark.createDataFrame([(i, t, "", 0, 0) for i, t in enumerate(texts)], DOCS)
    channel = toxicity.Channel(*toxicity.language(docs))
    for word in " ".join(texts[:2]).split():
        assert toxicity.words_of(word, channel) == [word]
    assert toxicity.words_of("peoople", channel) == ["people"]
    assert toxicity.joined_pieces("see the of and all", channel.common) == set()


def test_the_path_is_the_best_of_all():
    words = Counter("their other there these idiot radio".split())
    table = toxicity.model_of(toxicity.triples(words))
    channel = toxicity.Channel(table)
    for token in ["1d10t", "the$e", "o.t", "r@d!o", "thhhere", "0th3r"]:
        best = math.inf
        for marks in itertools.product(*(channel.options(token, i) for i in range(len(token)))):
            cost, a, b, text = 0.0, 0, 0, ""
            for mark, price in marks:
                cost += price
                if mark == " ":
                    if b:
                        cost, a, b, text = cost - table[a][b][0], 0, 0, text + " "
                elif mark:
                    s = toxicity.symbol(mark)
                    cost, a, b, text = cost - table[a][b][s], b, s, text + mark
            cost -= table[a][b][0] if b else 0.0
            if cost < best - 1e-12:
                best, answer = cost, text.strip()
        assert channel.restore(token) == answer


def test_counts_of_characters_cover_all_documents(spark):
    docs = spark.createDataFrame([(1, "ab ab", "", 0, 0), (2, "Ab, é", "", 0, 0), (3, None, "", 0, 0)], DOCS).repartition(3)
    counts = np.zeros(toxicity.SYMBOLS**3, int)
    for r in toxicity.character_counts(docs).collect():
        counts[r.triple] = r.n
    want = toxicity.triples(Counter({"ab": 2, "é": 1}))
    assert (counts == want).all() and want.sum() == 2 * 3 + 2


def test_nulls_empty_and_long_texts_and_repeated_rows(spark):
    rows = texts(200) + [(800, None, 0), (801, "", 0), (802, "x" * 50_000 + " 1" * 20_000, 0), (803, "\n", 0), (None, "a b", 1)] + texts(200)[:4]
    docs, labels = frames(spark, rows)
    got = toxicity.score_toxicity(docs, labels.union(spark.createDataFrame([(None, 1, 1), (1, 1, None)], LABELS))).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert len(got) == len(rows) and all(len(v) == 1 for v in by_id.values())
    assert max(by_id[800] | by_id[801] | by_id[803]) < 0.5


@pytest.mark.parametrize("label", [None, 0, 1])
def test_without_both_labels_every_score_is_0(spark, label):
    docs, _ = frames(spark, texts(30))
    labels = spark.createDataFrame([] if label is None else [(i, 1, label) for i in range(30)], LABELS)
    assert {r.score for r in toxicity.score_toxicity(docs, labels).collect()} == {0.0}


def test_empty_table(spark):
    docs, labels = frames(spark, texts(20))
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_a_small_sample_leaves_the_decisions_as_they_are(spark):
    # a word in two fifths of the toxic and a thirtieth of the other documents says little where few are toxic
    draw = random.Random(3)
    rows = []
    for i in range(4000):
        toxic = draw.random() < 0.04
        words = draw.choices(["stone", "river", "cloud", "maple", "candle"], k=6)
        if draw.random() < (0.4 if toxic else 0.03):
            words.append("hintword")
        if toxic and draw.random() < 0.3:
            words.append(draw.choice(BAD))
        rows.append((i, " ".join(words), int(toxic)))
    docs, labels = frames(spark, rows)
    train = toxicity.fold("doc_id", 5) >= 0
    some = ["stone river hintword cloud", "maple candle stone", "river grumbolt maple"]
    whole, bounded = (scores(toxicity.learn(docs, labels, train, sample=n), some) for n in (10_000, 300))
    assert ((whole >= 0.5) == [False, False, True]).all()
    assert ((bounded >= 0.5) == (whole >= 0.5)).all() and abs(bounded - whole).max() < 0.25


def test_triples_are_counted_word_by_word():
    words = Counter({"a": 3, "héllo": 2, "日本": 5, "Zz": 1, "": 4})
    want = np.zeros(toxicity.SYMBOLS**3, np.int64)
    for word, n in words.items():
        line = [0, 0, *map(toxicity.symbol, word), 0]
        for x, y, z in zip(line, line[1:], line[2:]):
            want[x * toxicity.SYMBOLS**2 + y * toxicity.SYMBOLS + z] += n
    assert (toxicity.triples(words) == want).all()


def plainly_restored(channel, token):
    """Whole strings in the paths, nothing shortened or passed over."""
    token, paths = token.lower(), {(0, 0): (0.0, "")}
    for at in range(len(token)):
        after = {}
        for (a, b), (cost, text) in paths.items():
            for mark, price in channel.options(token, at):
                if not mark or mark == " " and b == 0:
                    key, total, now = (a, b), cost + price, text
                elif mark == " ":
                    key, total, now = (0, 0), cost + price - channel.table[a][b][0], text + " "
                else:
                    s = toxicity.symbol(mark)
                    key, total, now = (b, s), cost + price - channel.table[a][b][s], text + mark
                if key not in after or total < after[key][0]:
                    after[key] = (total, now)
        paths = after
    return min((cost - (channel.table[a][b][0] if b else 0.0), text) for (a, b), (cost, text) in paths.items())[1].strip()


def test_linked_paths_give_the_same(monkeypatch):
    """Also where long tokens are decided piece by piece, and runs of signs are shortened."""
    rng = random.Random(5)
    text = "the thing inside another letter hello idiot mornings".split()
    channel = toxicity.Channel(toxicity.model_of(toxicity.triples(Counter(text * 20))))
    tokens = ["".join(rng.choices("aabeeiotthlors0134@$*.!-é", k=rng.randrange(1, 40))) for _ in range(400)]
    tokens += ["h3ll0" + "*" * n + "1d1ot" for n in (3, 20, 60, 200)]
    for long_token in (200, 5):
        monkeypatch.setattr(toxicity, "LONG_TOKEN", long_token)
        for token in tokens:
            assert channel.restore(token) == plainly_restored(channel, token)


def test_long_tokens_take_time_in_proportion():
    channel = toxicity.Channel(toxicity.model_of(toxicity.triples(Counter({"letter": 5, "word": 3}))))
    rng = random.Random(6)
    for token in ("*" * 10**6, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=10**6)), "a" * 10**4):
        start = time.process_time()
        channel.restore(token)
        assert time.process_time() - start < 4
    letters = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=20_000))
    times = []
    for token in (letters[:5000], letters):
        start = time.process_time()
        channel.restore(token)
        times.append(time.process_time() - start)
    assert times[1] < 12 * times[0]


def test_tokens_that_say_nothing_are_known_without_decoding():
    """may_say() is false only where no term stands behind a token."""
    rng = random.Random(7)
    text = "idiot moron hello letter bookkeeper a at the addiction".split()
    terms = {"idiot": 2.0, "idio-": 1.0, "hell-": 1.5, "bookk-": 1.2, "a": 0.5, "lette-": 0.4}
    scorer = toxicity.Scorer(toxicity.model_of(toxicity.triples(Counter(text * 9))), terms, {"hello": True, "bookkeeper": True, "the": True})
    for word in text * 30:
        token = "".join(c * rng.choice([1, 1, 1, 2, 3]) for c in word) + rng.choice(["", ".", "!!", "x"])
        found = [w for w in toxicity.words_of(token, scorer.channel) if any(t in terms for t in toxicity.terms_of(w))]
        assert scorer.may_say(token) or not found
    assert not scorer.may_say("zebra.")
