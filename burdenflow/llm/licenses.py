"""Licence scan: phrases and identifier tags found by an Aho-Corasick automaton, licence expressions by a parser.

Words are runs of letters and digits after A-Z are lower-cased (every character above U+007F counts as a letter).
One automaton, built from the words of all phrases, runs over the words of a text once and gives every place of
every phrase, overlapping places included. A phrase matches words that stand next to each other, whatever signs
and line breaks stand between them.

Where a text names an identifier after an SPDX tag, or a licence word, the expression that follows is read by a
shunting-yard parser: `and`, `or`, `with`, parentheses, `with` binding closest and `or` least. An expression
counts as far as it parses. After an identifier tag and a colon any word-shaped identifier is an operand, also one
that no list here knows (NONE and NOASSERTION name nothing); after small `and`, `or` or `with`, which running prose
has too, an unknown one needs a capital, a digit or a hyphen. After the other tags, and without a colon, operands
start like a known identifier, so that an expression ends where prose goes on. What it names is a label each; the
choice it allows tells how free the text is, and is null where that hangs on an unknown identifier.

Score: 1 - prod(1 - strength) over the distinct labels found, 0 without any.

A null text is an empty one and has no words, places or labels. Rows are handled one by one, so repeated rows give
repeated results and an empty table none; other columns of the input are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: The phrases whose places are counted, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices of well-known licences, with the identifier that each one is known by.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache-2.0",
    "mozilla public license": "mpl-2.0",
    "eclipse public license": "epl-2.0",
    "bsd license": "bsd-3-clause",
    "redistribution and use in source and binary forms": "bsd-3-clause",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0-1.0",
    "creative commons": "cc",
    "public domain": "public-domain",
    "free documentation license": "gfdl",
}
#: Words that an expression follows.
TAGS = ("spdx license identifier", "license expression", "dual licensed under", "licensed under either")
#: Those of them that with a colon stand before an expression and nothing else.
NAMING = TAGS[:2]
#: How sure a label makes it that the text is under a licence.
STRENGTH = {"base": 0.7, "notice": 0.6, "expression": 0.95}
#: What an identifier starts with, by family; the licence families that ask nothing of those who pass a text on come first.
PERMISSIVE = ("mit", "apache", "bsd", "isc", "cc0", "cc-by-4", "cc-by-3", "unlicense", "zlib", "0bsd", "python", "boost", "bsl")
COPYLEFT = ("gpl", "lgpl", "agpl", "mpl", "epl", "cc-by-sa", "gfdl", "eupl", "cddl")
_IDENTIFIER = re.compile(r"(?:%s)[a-z0-9.+-]*" % "|".join(sorted((re.escape(p) for p in PERMISSIVE + COPYLEFT + ("cc-by", "licenseref", "artistic")), key=len, reverse=True)))
#: What may stand between a tag and its expression, and the next sign or word of an expression.
_BETWEEN = re.compile(r"[ \t:*#/]*")
_STEP = re.compile(r"[ \t]*([()]|(?:documentref-[a-z0-9.-]+:)?[a-z0-9][a-z0-9.+-]*)", re.I | re.A)
#: What stands in place of an identifier where there is none.
_NOTHING = ("none", "noassertion")
_BINDS = {"or": 1, "and": 2, "with": 3}


def parse(text: str, any_name: bool = False, start: int = 0) -> list[str] | None:
    """The longest expression that stands at `start` of a text, in postfix order; None if there is none.

    any_name: identifiers may be unknown ones. Shunting-yard in one pass that remembers the last place where the
    expression was whole: what is out by then, and what waits; outside parentheses no more than one of each operator does.
    """
    out, waiting, inside, operand, before = [], [], 0, True, ""  # operand: an identifier or an opening parenthesis must come next
    whole: tuple[int, list[str]] | None = None
    while found := _STEP.match(text, start):
        start, written = found.end(), found[1].rstrip(".")
        token = written.translate(_LOWER)
        if token in _BINDS:
            if operand:
                break
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = True
        elif token == "(":
            if not operand:
                break
            waiting.append(token)
            inside += 1
        elif token == ")":
            if operand or not inside:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            inside -= 1
        else:
            after_with = waiting and waiting[-1] == "with"
            if not operand or not (after_with or _IDENTIFIER.fullmatch(token) or any_name and _is_name(written, before)):
                break
            out.append(token)
            operand = False
        if token != "(":
            before = written
        if not operand and not inside:
            whole = len(out), waiting[::-1]
    return out[: whole[0]] + whole[1] if whole else None


def _is_name(written: str, before: str) -> bool:
    """Whether a word after an identifier tag is an identifier, by its form and the operator before it."""
    if written.translate(_LOWER) in _NOTHING:
        return False
    return before not in _BINDS or bool(re.search(r"[A-Z0-9-]", written))


def both(left: bool | None, right: bool | None) -> bool | None:
    """`and` of values that may be unknown."""
    return False if left is False or right is False else None if left is None or right is None else True


def either(left: bool | None, right: bool | None) -> bool | None:
    """`or` of values that may be unknown."""
    return True if left or right else None if left is None or right is None else False


def evaluate(postfix: list[str]) -> tuple[set[str], bool | None]:
    """The identifiers that an expression names, and whether it leaves a choice without copyleft terms; None if unknown ones decide."""
    stack: list[tuple[set[str], bool | None]] = []
    for token in postfix:
        if token in _BINDS:
            (right, free), (left, also) = stack.pop(), stack.pop()
            if token != "with":  # the smaller set into the larger, so that a long expression stays cheap
                left, right = (left, right) if len(left) >= len(right) else (right, left)
                left |= right
            names = left
            stack.append((names, also if token == "with" else either(also, free) if token == "or" else both(also, free)))
        else:
            stack.append(({token}, token.startswith(PERMISSIVE) if _IDENTIFIER.fullmatch(token) else None))
    return stack.pop()


class Scanner:
    """The automaton of all phrases over words; one for each worker process."""

    def __init__(self, base: dict[str, str], notices: dict[str, str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for kind, phrases in (("base", base), ("notice", notices), ("tag", dict.fromkeys(TAGS, "") | dict.fromkeys(NAMING, "naming"))):
            for phrase, label in phrases.items():
                found.setdefault(f" {phrase} ", []).append((kind, label, len(phrase.split())))
        for phrase, uses in found.items():
            self.automaton.add_word(phrase, (len(phrase), uses))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> dict:
        lowered = (text or "").translate(_LOWER) if not (text or "").isascii() else (text or "").lower()
        words = _WORD.findall(lowered)
        line = f" {' '.join(words)} "
        # the start of each word is counted only as far as places ask for it
        base, labels, at, number, first, last, n_base, tags = set(), {}, 0, 0, None, None, 0, []
        for end, (length, uses) in sorted(self.automaton.iter(line), key=lambda hit: hit[0] - hit[1][0]):
            start = end - length + 1
            number += line.count(" ", at, start)
            at = start
            for kind, label, n in uses:
                if kind == "base":
                    n_base += 1
                    first = number if first is None else first
                    last = number
                    base.add(label)
                elif kind == "notice":
                    labels[label] = max(labels.get(label, 0.0), STRENGTH["notice"])
                else:
                    tags.append((number + n, label))
        choices = []
        if tags:
            ends = [m.end() for m in _WORD.finditer(lowered)]
            for after, naming in tags:
                between = _BETWEEN.match(lowered, ends[after - 1])
                # lower-casing leaves every character in its place; no expression goes on past the next tag
                if postfix := parse(text, bool(naming) and ":" in between[0], between.end()):
                    names, choice = evaluate(postfix)
                    labels |= dict.fromkeys(names, STRENGTH["expression"])
                    choices.append(choice)
        free = functools.reduce(both, choices) if choices else None
        rest = 1.0
        for label in sorted(base | set(labels)):
            rest *= 1 - max(labels.get(label, 0.0), STRENGTH["base"] if label in base else 0.0)
        return {
            "n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last, "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | set(labels))), "score": round(1 - rest, 12), "free_choice": free,
        }


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, free_choice boolean"
_scanners: dict[str, Scanner] = {}


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row for each document; free_choice tells whether all its expressions can be met without copyleft terms, null if that hangs on an unknown identifier."""

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = repr((base, notices))
        scanner = _scanners.get(key) or _scanners.setdefault(key, Scanner(base, notices))
        for batch in batches:
            out = pd.DataFrame([scanner.scan(t) for t in batch["text"]], columns=[c.split()[0] for c in RESULT.split(", ")][1:])
            out = out.astype({"first_word": "Int64", "last_word": "Int64", "free_choice": "boolean"})
            yield pd.concat([batch["doc_id"].astype("Int64").reset_index(drop=True), out], axis=1)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(scanned, RESULT)
