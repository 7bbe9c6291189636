"""Toxicity scores of texts after noisy-channel deobfuscation.

A token that holds letters together with digits, signs or runs of one letter, or letters of other scripts that look
like Latin ones, or letters standing alone one after another, is read as a noisy form of a word. A word that is
common in the corpus is taken as it is, and one with doubled letters that isn't, as the common word that it becomes
with some of them single, if there is one. Pieces of up to three letters one after another, at least half of them
uncommon, are also read as one word. Its characters become a lattice: each may stand for itself, for
the letters it is used for, for a gap between words, or for nothing (a separator, or one more copy of a letter).
A letter of another script may also stand for itself, so words of that script stay where the corpus has it.
The Viterbi algorithm finds the best path under the channel's costs and a character language model, whose counts
of three characters are gathered from all clean words of all documents. Words of the restored text are scored.

Terms are words and the beginnings of words. Their weight is the log-odds of being in toxic documents, learned
from at most `sample` labelled rows of each label. A document's evidence is its strongest terms, their sum and their
number; a logistic regression on evidence from terms of the other half of the sample gives the score. In it a
sampled row counts for all labelled rows of its label that it stands for, so the sample keeps their rate of toxic ones.

Null texts are empty ones; texts without a known term get the lowest score, below a half. A null doc_id counts as the
empty text where folds are formed and has no label. Repeated rows get a result each. Without toxic labels every
score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burdenflow.llm.labelled import bounded, fold, labels_of, passing
from burdenflow.llm.quality import logistic
from burdenflow.llm.slices import map_slices
from burdenflow.llm.store import keep

SAMPLE, SEED = 10_000, 29
#: A term's rate in toxic documents must be so many times that in others; at most so many terms are kept.
TIMES, TERMS = 8.0, 50_000
#: Words or tokens that a worker holds at a time.
HELD = 100_000
#: Words that occur so often, and at least once in so many words, are common; the most frequent ones, so many at most.
OFTEN, RARE, COMMON = 3, 10_000_000, 50_000
#: A piece of a word is common if it occurs at least once in so many words; pieces and letters of a word taken apart.
RARE_PIECE, PIECES, LETTERS_APART = 10_000, 8, 16
#: Letters that signs and digits are used for, cheapest first.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
    "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou", "%": "aeiou", "?": "aeiou",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ο": "o", "α": "a", "ι": "i",
}
SWAP, ANY, DROP, COPY, GAP = 1.5, 4.0, 1.0, 1.0, 2.5
#: What reading a sign costs more than dropping it, at least; tokens above so many characters are decided piece by piece.
SPARE, LONG_TOKEN = 0.5, 200
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the model: the edge of a word, the letters, any other letter.
SYMBOLS = 28

_RUN = re.compile(r"(.)\1\1", re.S)
_ALONE = re.compile(r"(?<!\S)[^\W_](?:[ .\-_*][^\W_]){2,}(?!\S)")
_PIECES = re.compile(r"(?<![^\s(\"'])[^\W_]{1,3}(?:[ .\-_*][^\W_]{1,3})+(?=[.,;:!?)\"']*(?!\S))")
_APART = re.compile(r"[ .\-_*]")
_TWICE = re.compile(r"([^\W\d_])\1")
_LIKE = re.compile("[%s]" % "".join(c for c in LOOKS if c.isalpha()))
_EDGES = re.compile(r"^[^\w@$!|<(€£¡*+]+|[^\w]+$|_+$|^_+")
_SIGNS = re.compile(r"([^\w\s])\1+")
_FREE = re.compile(r"(?:([a-z])(?!\1))+(?![^\W\d_])|(?:([a-z])(?!\2))+(?=[a-z])")
_PAIR = re.compile(r"(.)\1", re.S | re.I)
_STOPS = (".", ",", ";", ":", "!", "?")
_AGAIN = re.compile(r"(.)\1+", re.S)
_known: dict[str, int] = {}


def symbol(letter: str) -> int:
    """Number of a letter without its accents; 27 for letters that aren't Latin."""
    if letter not in _known:
        plain = unicodedata.normalize("NFKD", letter.lower())[:1]
        _known[letter] = LETTERS.find(plain) + 1 or 27
    return _known[letter]


def triples(words: Counter) -> np.ndarray:
    """How often three symbols follow each other, in words with their counts; two edges stand before a word and one after."""
    if not words:
        return np.zeros(SYMBOLS**3, np.int64)
    letters, coded = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), return_inverse=True)
    coded = np.array([symbol(chr(c)) for c in letters.tolist()])[coded]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    line = np.zeros(len(coded) + 3 * len(words), np.int64)
    line[np.arange(len(coded)) + np.repeat(3 * np.arange(len(words)) + 2, sizes)] = coded
    weight = np.repeat(np.fromiter(words.values(), np.int64, len(words)), sizes + 3)
    ends = np.cumsum(sizes + 3)
    inside = np.ones(len(line), bool)  # a triple is counted where it ends, from the third place of a word on
    inside[ends - sizes - 3] = inside[ends - sizes - 2] = False
    number = line[:-2] * SYMBOLS**2 + line[1:-1] * SYMBOLS + line[2:]
    inside = inside[2:]
    return np.bincount(number[inside], weight[2:][inside], SYMBOLS**3).astype(np.int64)


def model_of(counts: np.ndarray) -> np.ndarray:
    """Log-probability of a symbol after two others, mixed with what one symbol says."""
    table = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    single = (table.sum(axis=(0, 1)) + 1) / (table.sum() + SYMBOLS)
    double = (table.sum(axis=0) + 2 * single) / (table.sum(axis=0).sum(axis=1, keepdims=True) + 2)
    return np.log((table + 2 * double[None]) / (table.sum(axis=2, keepdims=True) + 2))


class Channel:
    """Restores noisy tokens; the same token is decoded once for each worker process."""

    def __init__(self, log_probabilities: np.ndarray, common: dict[str, bool] | None = None):
        self.table, self.common = log_probabilities.tolist(), common or {}
        self.signs = math.ceil(3 * -float(log_probabilities.min()) / SPARE) + 1

    def options(self, token: str, at: int) -> list[tuple[str, float]]:
        """What a character may stand for, with its cost; '' is nothing and ' ' a gap."""
        c = token[at]
        out = []
        if c.isalpha() and c not in LOOKS:
            out.append((c, 0.0))
            if at and token[at - 1] == c:
                out.append(("", COPY if at > 1 and token[at - 2] == c or at + 1 < len(token) and token[at + 1] == c else 3 * COPY))
            return out
        looks = LOOKS.get(c, "")
        if c.isalpha():
            out.append((c, 0.0))
        out += [(x, (ANY if len(looks) > 2 else SWAP + 0.3 * i)) for i, x in enumerate(looks)]
        if at and token[at - 1] == c and looks:
            out.append(("", 3 * COPY))
        if not c.isalnum():
            out += [("", DROP), (" ", GAP)]
        elif not looks:
            out.append((" ", GAP))
        else:
            out.append((" ", 3 * GAP))
        return out

    def shortened(self, token: str) -> str:
        """Long runs of one sign cut to a length at which a longer run gives the same text.

        A path that reads a sign as a letter or a gap pays at least SPARE more than one that drops it, and dropping it
        changes the model's price of three symbols at most. So no best path reads more of a run's signs than
        `self.signs`; the others are dropped, which costs every path the same.
        """
        return _SIGNS.sub(lambda run: run[0][: self.signs], token) if len(token) > self.signs else token

    def restore(self, token: str) -> str:
        """The likeliest text behind a token, by Viterbi over the last two symbols.

        A path is a chain of marks, each linked to those before it. Where one state is left, all paths have one
        beginning, which is decided; in a long token, letters that can only stand for themselves are then passed over.
        """
        token, table, decided, at = self.shortened(token.lower()), self.table, [], 0
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        while at < len(token):
            if len(paths) == 1 and len(token) > LONG_TOKEN:
                ((a, b), (cost, chain)), = paths.items()
                decided.append(marks_of(chain))
                run = _FREE.match(token, at)
                if run and not (at and token[at - 1] == token[at]):
                    decided.append(run[0])
                    a, b, at = symbol(run[0][-2]) if len(run[0]) > 1 else b, symbol(run[0][-1]), run.end()
                paths = {(a, b): (0.0, None)}
                if at == len(token):
                    break
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            options = self.options(token, at)
            for (a, b), (cost, chain) in paths.items():
                for mark, price in options:
                    if not mark:
                        key, total, now = (a, b), cost + price, chain
                    elif mark == " ":
                        if b == 0:
                            key, total, now = (a, b), cost + price, chain
                        else:
                            key, total, now = (0, 0), cost + price - table[a][b][0], (" ", chain)
                    else:
                        s = symbol(mark)
                        key, total, now = (b, s), cost + price - table[a][b][s], (mark, chain)
                    if key not in after or total < after[key][0]:
                        after[key] = (total, now)
            paths, at = after, at + 1
        ends = [(cost - (table[a][b][0] if b else 0.0), chain) for (a, b), (cost, chain) in paths.items()]
        least = min(cost for cost, _ in ends)
        return ("".join(decided) + min(marks_of(chain) for cost, chain in ends if cost == least)).strip()


def marks_of(chain: tuple | None) -> str:
    out = []
    while chain is not None:
        mark, chain = chain
        out.append(mark)
    return "".join(reversed(out))


def words_of(token: str, channel: Channel) -> list[str]:
    """The words that a token without white space stands for."""
    if token.isalpha() and not _RUN.search(token):
        return plain_words(token.lower(), channel)
    core = _EDGES.sub("", token)
    if not core or not any(c.isalpha() for c in core) and len(core) < 3:
        return []
    if core.isalpha() and not _RUN.search(core):
        return plain_words(core.lower(), channel)
    return channel.restore(core).split()


def plain_words(word: str, channel: Channel) -> list[str]:
    """The words behind a word of letters, which is kept if it is common or holds neither doubled letters nor look-alikes."""
    if word in channel.common:
        return [word]
    if _LIKE.search(word):
        return channel.restore(word).split()
    places = [m.start() for m in _TWICE.finditer(word)]
    if not places:
        return [word]
    for n in range(1, len(places) + 1 if len(places) <= 6 else 1):
        for dropped in itertools.combinations(places, n):
            single = "".join(c for i, c in enumerate(word) if i not in dropped)
            if single in channel.common:
                return [single]
    return channel.restore(word).split()


def terms_of(word: str) -> list[str]:
    """A word and its beginnings, which are marked by a hyphen."""
    return [word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) >= n)]


def joined_letters(text: str) -> list[str]:
    """Tokens from letters that stand alone one after another."""
    return [m[0].replace(" ", "") for m in _ALONE.finditer(text)]


def joined_pieces(text: str, common: dict[str, bool]) -> set[str]:
    """What short pieces one after another give as one word, where at least half of them are uncommon by themselves."""
    out: set[str] = set()
    for run in _PIECES.finditer(text):
        pieces = _APART.split(run[0].lower())
        odd = [not p.isdigit() and not common.get(p, False) for p in pieces]
        if not any(odd):
            continue
        for start in range(len(pieces) - 1):
            word, n = pieces[start], int(odd[start])
            for end in range(start + 1, min(len(pieces), start + PIECES)):
                word, n = word + pieces[end], n + odd[end]
                if len(word) > LETTERS_APART:
                    break
                if 2 * n >= end - start + 1 and len(word) > 2:
                    out.add(word)
    return out


def corpus_counts(docs: DataFrame) -> DataFrame:
    """Counts of three symbols over the clean words of all documents, and of these words: triple or word, n."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, words = np.zeros(SYMBOLS**3, np.int64), Counter()

        def flush():
            clean = Counter({w: n for w, n in words.items() if w.isalpha() and not _RUN.search(w)})
            total[:] += triples(clean)
            words.clear()
            lowered = Counter()
            for w, n in clean.items():
                if len(w) <= 24:
                    lowered[w.lower()] += n
            return pd.DataFrame({"triple": pd.Series([None] * len(lowered), dtype="Int32"), "word": pd.Series(list(lowered), dtype=object), "n": pd.Series(list(lowered.values()), dtype="int64")})

        for batch in batches:
            for text in batch["text"]:
                words.update((text or "").split())
                if len(words) > HELD:
                    yield flush()
        yield flush()
        found = np.flatnonzero(total)
        yield pd.DataFrame({"triple": found, "word": pd.Series([None] * len(found), dtype=object), "n": total[found]})

    counts = map_slices(docs.select("text"), counted, "triple int, word string, n long")
    return counts.groupBy("triple", "word").agg(F.sum("n").alias("n"))


def character_counts(docs: DataFrame) -> DataFrame:
    """Counts of three symbols over the clean words of all documents: triple, n."""
    return corpus_counts(docs).filter("triple is not null").select("triple", "n")


def language(docs: DataFrame) -> tuple[np.ndarray, dict[str, bool]]:
    """The character model of a corpus, and its common words with whether they are common as pieces too.

    At most SYMBOLS ** 3 counts and COMMON words come to the driver.
    """
    kept = keep(corpus_counts(docs).filter(F.col("triple").isNotNull() | (F.col("n") >= OFTEN)), "toxicity-counts")
    counts = np.zeros(SYMBOLS**3, np.int64)
    for row in kept.filter("triple is not null").collect():
        counts[row["triple"]] = row["n"]
    n_words = int(counts.reshape(-1, SYMBOLS)[:, 0].sum())
    words = kept.filter("word is not null").filter(F.col("n") * RARE >= n_words).orderBy(F.desc("n"), "word").limit(COMMON)
    return model_of(counts), {r["word"]: r["n"] * RARE_PIECE >= n_words for r in words.collect()}


def document_terms(text: str | None, channel: Channel, memory: dict) -> set[str]:
    """Distinct terms of the restored text."""
    out: set[str] = set()
    text = text or ""
    for token in {*text.split(), *joined_letters(text)}:
        known = memory.get(token)
        if known is None:
            known = tuple(t for w in words_of(token, channel) for t in terms_of(w))
            remember(memory, token, known)
        out.update(known)
    for word in joined_pieces(text, channel.common):
        out.update(words_of(word, channel))
    return out


def remember(memory: dict, key, value, most: int = HELD) -> None:
    if len(memory) >= most:
        memory.clear()
    if len(key) <= 64:
        memory[key] = value


def term_counts(sampled: DataFrame, model: np.ndarray, common: dict[str, bool] | None = None) -> DataFrame:
    """Documents of each label and half of the sample that hold a term: term, toxic0, toxic1, clean0, clean1."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel, memory, counts = Channel(model, common), {}, [Counter() for _ in range(4)]
        for batch in batches:
            for text, label, half in zip(batch["text"], batch["label"], batch["half"]):
                counts[2 * (label == 0) + half].update(document_terms(text, channel, memory))
            if sum(map(len, counts)) > 2 * HELD:
                yield frame(counts)
                counts = [Counter() for _ in range(4)]
        yield frame(counts)

    def frame(counts):
        terms = list(set().union(*counts))
        return pd.DataFrame({"term": pd.Series(terms, dtype=str), **{n: [c[t] for t in terms] for n, c in zip(names, counts)}})

    names = ("toxic0", "toxic1", "clean0", "clean1")
    rows = sampled.select("text", "label", "half").mapInPandas(found, "term string, toxic0 long, toxic1 long, clean0 long, clean1 long")
    return rows.groupBy("term").agg(*(F.sum(n).alias(n) for n in names))


def weights_of(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    return np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))


def evidence(weights: list[float], size: int) -> list[float]:
    """What a document's distinct terms say: strongest, second, sum, number, and number for its length."""
    best = sorted(weights, reverse=True)
    return [best[0] if best else 0.0, best[1] if len(best) > 1 else 0.0, min(60.0, sum(best)), math.log1p(len(best)), 100 * len(best) / (size + 100)]


class Scorer:
    """Weights of tokens under one set of terms."""

    def __init__(self, model: np.ndarray, terms: dict[str, float], common: dict[str, bool] | None = None):
        self.channel, self.terms = Channel(model, common), terms
        single = {t: _AGAIN.sub(r"\1", t.removesuffix("-")) for t in terms}
        self.whole = {c for t, c in single.items() if not t.endswith("-")}
        self.heads = {c for t, c in single.items() if t.endswith("-")}
        self.lengths = sorted({len(c) for c in self.heads})
        # tokens known to say nothing, in two generations, and the words of others
        self.nothing, self.older, self.words = set(), set(), {}

    def may_say(self, token: str) -> bool:
        """Whether a term may stand behind the token: False only if none can.

        Letters without look-alikes are read as themselves or, repeated, as one of them, so without repeats the word
        behind them begins as they do, and as its terms do.
        """
        core = token[:-1] if token[-1:] in _STOPS else token
        if not core.isalpha() or _LIKE.search(core):
            return True
        head = _AGAIN.sub(r"\1", core.lower()) if _PAIR.search(core) else core.lower()
        if head in self.whole:
            return True
        for n in self.lengths:
            if head[:n] in self.heads:
                return True
        return False

    def weight(self, token: str) -> tuple[tuple[str, float], ...]:
        """Of each word behind the token, the word's beginning (or the word) that says most, if any does."""
        if not self.may_say(token):
            return ()
        out = []
        for word in words_of(token, self.channel):
            best = max((self.terms[t] for t in terms_of(word) if t in self.terms), default=0.0)
            if best:
                out.append((word, best))
        return tuple(out)

    def evidence(self, text: str | None) -> list[float]:
        text = text or ""
        tokens = {*text.split(), *joined_letters(text)}
        found: dict[str, float] = {}
        for token in tokens - self.nothing:
            if token in self.older:
                self.passed(token)
                continue
            known = self.words.get(token)
            if known is None:
                known = self.weight(token)
                if known:
                    remember(self.words, token, known)
                else:
                    self.passed(token)
            found.update(known)
        for word in joined_pieces(text, self.channel.common):
            if self.may_say(word):
                found.update((w, self.terms[w]) for w in words_of(word, self.channel) if w in self.terms)
        return evidence(list(found.values()), len(tokens))

    def passed(self, token: str) -> None:
        if len(token) <= 64:
            if len(self.nothing) >= HELD:
                self.nothing, self.older = set(), self.nothing
            self.nothing.add(token)


class Model:
    """Everything that scoring needs, learned once."""

    def __init__(self, characters: np.ndarray, terms: dict[str, float], weights: np.ndarray | None, common: dict[str, bool] | None = None):
        self.characters, self.terms, self.weights, self.common = characters, terms, weights, common

    def scorer(self):
        """Scores of texts, with a memory for tokens seen before."""
        scorer = Scorer(self.characters, self.terms, self.common)
        return lambda texts: self.scores(np.array([scorer.evidence(t) for t in texts], float).reshape(len(texts), len(evidence([], 0))))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(rows))
        return 1 / (1 + np.exp(-np.clip((np.c_[rows, np.ones(len(rows))] * self.weights).sum(axis=1), -30, 30)))


def chosen(counts: pd.DataFrame, toxic: list[str], clean: list[str], n_toxic: int, n_clean: int) -> dict[str, float]:
    t, c = counts[toxic].sum(axis=1).to_numpy(), counts[clean].sum(axis=1).to_numpy()
    w = weights_of(t, c, n_toxic, n_clean)
    keep_ = (t >= max(2, math.ceil(math.log10(n_toxic + 1)))) & (w >= math.log(TIMES))  # chance finds grow with the sample
    order = np.lexsort((counts["term"].to_numpy()[keep_], -(t * w)[keep_]))[:TERMS]
    return dict(zip(counts["term"].to_numpy()[keep_][order], w[keep_][order].tolist()))


def learn(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> Model:
    """Learn from at most `sample` documents of each label for which the condition holds, and the characters of all."""
    characters, common = language(docs)
    known = keep(docs.select("doc_id").filter(train).distinct().join(labels_of(labels, "toxic"), "doc_id"), "toxicity-labelled")
    labelled = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = keep(bounded(known.filter("label = 1"), sample, SEED).unionByName(bounded(known.filter("label = 0"), sample, SEED)), "toxicity-sample")
    sampled = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most 2 * sample pairs of numbers
    sampled = keep(sampled.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")), "toxicity-texts")
    size = {(r["label"], r["half"]): r["n"] for r in sampled.groupBy("label", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [[size.get((label, half), 0) for half in (0, 1)] for label in (1, 0)]
    if not sum(n[0]) or not sum(n[1]):
        return Model(characters, {}, None, common)
    counts = term_counts(sampled, characters, common)
    rate = (F.col("toxic0") + F.col("toxic1")) / sum(n[0])
    held = counts.filter("toxic0 + toxic1 >= 2").filter(rate >= TIMES / 2 * (F.col("clean0") + F.col("clean1")) / sum(n[1]))
    held = held.orderBy(F.desc(F.col("toxic0") + F.col("toxic1")), "term").limit(4 * TERMS).toPandas()
    halves = [chosen(held, [f"toxic{h}"], [f"clean{h}"], n[0][h], n[1][h]) for h in (0, 1)]

    def other_half(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(characters, terms, common) for terms in halves]
        for batch in batches:
            rows = [scorers[1 - half].evidence(text) for text, half in zip(batch["text"], batch["half"])]
            yield pd.DataFrame({"label": batch["label"], "row": rows})

    seen = sampled.mapInPandas(other_half, "label int, row array<double>").toPandas()
    x, y = np.stack(seen["row"].to_list()), seen["label"].to_numpy()
    order = np.lexsort(np.c_[x, y].T)  # the sum must not depend on the order in which rows come
    times = np.array([labelled[label] / min(sample, labelled[label]) for label in y.tolist()])
    weights = logistic(np.c_[x, np.ones(len(x))][order], y[order], 1e-4, times=times[order])
    return Model(characters, chosen(held, ["toxic0", "toxic1"], ["clean0", "clean1"], sum(n[0]), sum(n[1])), weights, common)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of documents doc_id, text."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = model.scorer()
        for batch in batches:
            yield batch[["doc_id"]].assign(score=scores(batch["text"]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(score, "doc_id long, score double")


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.5) for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held_out = fold("doc_id", folds) == held
    out = scored(rows, learn(rows, labels, ~held_out)).select("doc_id", held_out.alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def not_toxic(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """The documents with a score below a half, learned as in score_toxicity()."""
    model = learn(docs, labels, fold("doc_id", folds) != held)

    def decide():
        scores = model.scorer()
        return lambda texts: scores(texts) < 0.5

    return passing(docs, decide)
