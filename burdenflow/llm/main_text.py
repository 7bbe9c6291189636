"""Main text of web pages by a recurrent block labeller.

A page is a sequence of text blocks. A block is described by its tag path (elements, their classes and ids) and its
hashed words; a bidirectional LSTM in numpy reads the whole sequence and says for every block whether it belongs to
the article, so what stands before and after a block counts as much as the block itself. The blocks chosen, in page
order, are the text.

No page is labelled. The labeller learns from at most `sample` pages whose own markup tells (an article element and
what is set apart from it) and from rearrangements of their blocks in other markup: other containers, menus, side
bars, notices, adverts, forms and reader comments in and around the article.

Null and empty pages have an empty text, as have pages without blocks of an article. Long pages are read whole.
Rows are handled one by one, so repeated rows give repeated results and an empty table none. Other columns are not
read. Without any page that tells, the labeller learns from rearrangements of all blocks of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burdenflow.llm.blocks import PATH, WIDTH, Block, blocks_of, vector

SAMPLE, SEED, HIDDEN, STEPS, PAGES = 400, 31, 16, 260, 24
ARTICLE = ({"article", "main"}, {"article", "main", "content", "post", "entry", "story", "body"})
#: Elements and words of class names that set a part of a page apart from its article.
APART = (
    {"nav", "header", "footer", "aside", "form", "head", "menu", "button", "select", "dialog"},
    set("nav menu header footer aside sidebar side ad advert advertisement sponsored promo banner cookie notice consent popup modal comment reply respond discu form search login subscribe newsletter related share social breadcrumb copyright widget pagination".split()),
)
#: Containers for rearranged pages.
_BODIES = [("article", ()), ("main", ()), ("div", ("article",)), ("div", ("content",)), ("div", ("post", "body")), ("section", ("story",)), ("div", ("entry", "content")), ("div", ("main",))]
_ASIDES = [("nav", ()), ("header", ()), ("footer", ()), ("aside", ()), ("form", ()), ("menu", ()), ("dialog", ())] + [
    (tag, names)
    for tag in ("div", "section", "ul")
    for names in (
        ("nav",), ("menu",), ("header",), ("site", "header"), ("footer",), ("sidebar",), ("side", "bar"), ("ad",), ("advert",), ("sponsored",), ("promo",), ("banner",), ("cookie", "notice"),
        ("notice",), ("consent",), ("popup",), ("comment",), ("comment", "list"), ("user", "comment"), ("reply",), ("form",), ("search",), ("newsletter",), ("related",), ("share",), ("social",),
        ("breadcrumb",), ("copyright",), ("widget",), ("cookie", "banner"), ("subscribe",), ("modal",), ("advertisement",), ("login",), ("respond",), ("reader", "comment"),
    )
]
_COMMENTS = [x for x in _ASIDES if {"comment", "reply", "respond"} & set(x[1])]


def told(page: list[Block]) -> list[int] | None:
    """Labels that the page's own markup gives, if it has an article element."""
    labels = []
    for block in page:
        inside = apart = False
        for tag, names in block.path:
            if tag in ARTICLE[0]:
                inside, apart = True, False
            elif tag in APART[0] or APART[1] & set(names):
                apart = True
        labels.append(int(inside and not apart))
    return labels if any(labels) else None


def rearranged(page: list[Block], labels: list[int], draw: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The page's article in another container, among and around other parts."""
    body = [("html", ()), ("body", ())] + [("div", ("page",))] * int(draw.integers(2))
    holder = _BODIES[draw.integers(len(_BODIES))]
    texts = [b.text for b in page]
    inner = [(b.path[-1][0] if b.path and b.path[-1][0] in ("p", "h1", "h2", "li", "pre", "blockquote") else "p") for b, y in zip(page, labels) if y]
    own = [b for b, y in zip(page, labels) if y]

    def part(around: list, most: int) -> list[tuple[Block, int]]:
        box = _ASIDES[draw.integers(len(_ASIDES))] if len(around) == len(body) else (_COMMENTS + _ASIDES)[draw.integers(len(_COMMENTS) + len(_ASIDES))]
        made = []
        for _ in range(int(draw.integers(1, most))):
            text = texts[draw.integers(len(texts))]
            words = text.split()
            text = " ".join(words[: int(draw.integers(1, 40))]) if draw.random() < 0.7 else text
            last = [("p", ()), ("li", ()), ("div", ()), ("h3", ()), ("span", ())][draw.integers(5)]
            nested = [box] + ([("div", (("comment", "item", "box", "inner")[draw.integers(4)],))] if draw.random() < 0.3 else [])
            linked = len(text) if last[0] == "li" and draw.random() < 0.6 else 0
            made.append((Block(text, tuple(around + nested + ([last] if last[0] != "span" else [])), linked), 0))
        return made

    out: list[tuple[Block, int]] = [(Block(texts[0][:60] or "x", (("html", ()), ("head", ()), ("title", ())), 0), 0)]
    for _ in range(int(draw.integers(0, 4))):
        out += part(body, 8)
    around = body + [holder] + ([("div", (("text", "inner", "body")[draw.integers(3)],))] if draw.random() < 0.2 else [])
    for i, (b, tag) in enumerate(zip(own, inner)):
        if i and draw.random() < 0.06:
            out += part(around, 3)
        out.append((Block(b.text, tuple(around + [(tag, ())]), b.linked), 1))
    if draw.random() < 0.3:
        out += part(around, 6)
    for _ in range(int(draw.integers(0, 4))):
        out += part(body, 6)
    return [b for b, _ in out], [y for _, y in out]


def matrix(page: list[Block]) -> np.ndarray:
    """One row of numbers for each block."""
    rows = np.zeros((len(page), WIDTH), np.float32)
    for i, block in enumerate(page):
        path, rest = vector(block, (i + 1) / len(page))
        rows[i, path] = 1
        rows[i, PATH:] = rest
    return rows


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((longest, len(pages), WIDTH), np.float32), np.zeros((longest, len(pages), 1), np.float32)
    for i, p in enumerate(pages):
        x[: len(p), i], mask[: len(p), i] = p, 1
    return x, mask


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over blocks, with one logistic unit on both states of a block."""

    def __init__(self, hidden: int = HIDDEN, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {"out": draw.normal(0, 0.3, (2 * hidden, 1)), "bias": np.zeros(1)}
        for way in "fb":
            self.p[f"x{way}"] = draw.normal(0, 0.2, (WIDTH, 4 * hidden))
            self.p[f"h{way}"] = draw.normal(0, 0.2, (hidden, 4 * hidden))
            self.p[f"c{way}"] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]  # forget gates start open
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x, mask, way):
        """States of one direction and what going back through it needs; padding leaves the state as it is."""
        k, p = self.hidden, self.p
        inputs = x @ p[f"x{way}"] + p[f"c{way}"]
        h = c = np.zeros((x.shape[1], k), np.float32)
        states, kept = np.zeros((*x.shape[:2], k), np.float32), [None] * len(x)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            z = inputs[t] + h @ p[f"h{way}"]
            s = sigmoid(z[:, : 3 * k])
            i, f, o, g = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :], np.tanh(z[:, 3 * k :])
            new = f * c + i * g
            squashed, m = np.tanh(new), mask[t]
            kept[t] = (h, c, i, f, o, g, squashed)
            h, c = m * o * squashed + (1 - m) * h, m * new + (1 - m) * c
            states[t] = h
        return states, kept

    def chances(self, x, mask):
        states = np.concatenate([self._run(x, mask, "f")[0], self._run(x, mask, "b")[0]], axis=2)
        return sigmoid(states @ self.p["out"] + self.p["bias"])[:, :, 0]

    def gradients(self, x, mask, y):
        """Of the mean log loss over blocks."""
        k, p = self.hidden, self.p
        runs = {way: self._run(x, mask, way) for way in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        error = (sigmoid(both @ p["out"] + p["bias"]) - y[:, :, None]) * mask / mask.sum()
        g = {"out": np.einsum("tbk,tbj->kj", both, error), "bias": error.sum(axis=(0, 1))}
        down = error @ p["out"].T
        for n, way in enumerate("fb"):
            top, kept = down[:, :, n * k : (n + 1) * k], runs[way][1]
            dz_all = np.zeros((*x.shape[:2], 4 * k), np.float32)
            recurrent = np.zeros_like(p[f"h{way}"])
            dh = dc = np.zeros((x.shape[1], k), np.float32)
            for t in range(len(x) - 1, -1, -1) if way == "f" else range(len(x)):
                h, c, i, f, o, a, squashed = kept[t]
                m = mask[t]
                dh = dh + top[t]
                new = m * (dh * o * (1 - squashed**2) + dc)
                z = np.concatenate([new * a * i * (1 - i), new * c * f * (1 - f), m * dh * squashed * o * (1 - o), new * i * (1 - a**2)], axis=1)
                dz_all[t] = z
                recurrent += h.T @ z
                dh, dc = z @ p[f"h{way}"].T + (1 - m) * dh, new * f + (1 - m) * dc
            g[f"x{way}"] = np.einsum("tbd,tbk->dk", x, dz_all, optimize=True)
            g[f"h{way}"], g[f"c{way}"] = recurrent, dz_all.sum(axis=(0, 1))
        return g

    def learn(self, pages, steps: int = STEPS, batch: int = PAGES, rate: float = 0.01, seed: int = SEED):
        """pages: makes a list of so many (matrix, labels) from a generator. Adam on batches."""
        draw = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            chosen = pages(batch, draw)
            x, mask = padded([m for m, _ in chosen])
            y = np.zeros(mask.shape[:2], np.float32)
            for i, (_, labels) in enumerate(chosen):
                y[: len(labels), i] = labels
            for k, g in self.gradients(x, mask, y).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                self.p[k] -= (move * min(1.0, 2 * (1 - step / (steps + 1)))).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray], most: int = 60_000) -> list[np.ndarray]:
        """Which blocks belong to the article; pages of like length go through together, `most` blocks at a time."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order, at = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i])), 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 512 and len(pages[order[end]]) * (end + 1 - at) <= most:
                end += 1
            some = order[at:end]
            found = self.chances(*padded([pages[i] for i in some])) >= 0.5
            for n, i in enumerate(some):
                out[i] = found[: len(pages[i]), n]
            at = end
        return out


def train(sample: list[str | None], longest: int = 120) -> Labeller:
    """Learn from whole sampled pages; one with very many blocks is learned from in parts, one after another."""
    parsed = [b for b in map(blocks_of, sample) if b]
    parts = lambda b, y: [(b[at : at + longest], y[at : at + longest]) for at in range(0, len(b), longest)]
    known = [part for b in parsed if (y := told(b)) for part in parts(b, y)]
    real = [(matrix(b), y) for b, y in known]
    if not known:
        known = [part for b in parsed for part in parts(b, [1] * len(b))]
    if not known:
        return Labeller()

    def pages(n, draw):
        made = []
        for _ in range(n):
            i = int(draw.integers(len(known)))
            if real and draw.random() < 0.3:
                made.append(real[i])
            else:
                blocks, labels = rearranged(*known[i], draw)
                made.append((matrix(blocks), labels))
        return made

    return Labeller().learn(pages)


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [blocks_of(p) for p in batch["html"]]
            chosen = labeller.label([matrix(b) for b in parsed])
            texts = ["\n\n".join(b.text for b, keep in zip(page, kept) if keep) for page, kept in zip(parsed, chosen)]
            yield batch[["page_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInPandas(extracted, "page_id long, url string, text string, n_chars long")


def learn_from(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """A labeller from at most `sample` pages, chosen by a hash of page_id and url; only those pages leave their tasks."""
    mark = F.xxhash64(F.lit(SEED), F.col("page_id"), F.col("url"))
    marks = pages.select(mark.alias("mark")).distinct().orderBy("mark").limit(sample)
    chosen = pages.select(mark.alias("mark"), "html").join(F.broadcast(marks), "mark")  # at most `sample` numbers
    return train([r["html"] for r in chosen.groupBy("mark").agg(F.min("html").alias("html")).orderBy("mark").collect()])


def main_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return extract(pages, learn_from(pages, sample))
