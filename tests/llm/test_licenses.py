"""Licence scan against brute force, and the parser against truth tables."""

import random
import re
import time

import pytest

from burdenflow.llm import licenses

SCHEMA = "doc_id long, text string, labels string, score int"


def brute(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = []
    for phrase, label in licenses.BASE.items():
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None, "", "...", "All rights\nreserved.", "CC BY-NC 4.0; cc-by cc by", "the GNU General Public License, version 3.", "all rights reserved " * 500,
    "cc all rights all rights reserved by", "ALL İRIGHTS reserved; Kcc by", "SPDX-License-Identifier: MIT OR Apache-2.0\nmore and more", "x" * 100000 + " cc by",
]


def test_places_of_base_phrases(spark):
    random.seed(2)
    vocabulary = "cc by general public license all rights reserved Lesser x ré 9".split()
    texts = TEXTS + [random.choice([" ", "-", "\n"]).join(random.choices(vocabulary, k=random.randint(0, 40))) for _ in range(300)]
    got = licenses.scan_licenses(spark.createDataFrame([(i, t, "l", 1) for i, t in enumerate(texts)], SCHEMA)).collect()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and (r.score > 0) == bool(r.labels)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "cc by", None, None)] * 3
    got = licenses.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.doc_id, r.n_base, r.free_choice) for r in got] == [(None, 1, None)] * 3
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    "text,names,free",
    [
        ("MIT", {"mit"}, True),
        ("MIT OR Apache-2.0", {"mit", "apache-2.0"}, True),
        ("GPL-2.0-only AND MIT", {"gpl-2.0-only", "mit"}, False),
        ("GPL-2.0 OR MIT AND Apache-2.0", {"gpl-2.0", "mit", "apache-2.0"}, True),
        ("(GPL-2.0 OR MIT) AND LGPL-3.0", {"gpl-2.0", "mit", "lgpl-3.0"}, False),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR BSD-3-Clause", {"gpl-2.0", "bsd-3-clause"}, True),
        ("MIT this file is free", {"mit"}, True),
    ],
)
def test_expressions(text, names, free):
    assert licenses.evaluate(licenses.parse(text)) == (names, free)
    out = licenses.Scanner(licenses.BASE, licenses.NOTICES).scan(f"# SPDX-License-Identifier: {text}\nint x;")
    assert names <= set(out["labels"].split(",")) and out["free_choice"] is free


@pytest.mark.parametrize(
    "text,names,free",
    [
        *((name, {name.lower()}, None) for name in "PostgreSQL OFL-1.1 WTFPL NCSA PSF-2.0 MS-PL OSL-3.0".split()),
        ("MIT AND OSL-3.0", {"mit", "osl-3.0"}, None),
        ("MIT OR (OSL-3.0 AND GPL-2.0)", {"mit", "osl-3.0", "gpl-2.0"}, True),
        ("NCSA AND GPL-2.0-only", {"ncsa", "gpl-2.0-only"}, False),
        ("MIT and or so", {"mit"}, True),
        ("MIT and the rest", {"mit"}, True),
        ("DocumentRef-a:LicenseRef-b AND MIT", {"documentref-a:licenseref-b", "mit"}, None),
        ("NOASSERTION", set(), None),
    ],
)
def test_identifiers_of_any_name_after_an_identifier_tag(text, names, free):
    out = licenses.Scanner(licenses.BASE, licenses.NOTICES).scan(f"// SPDX-License-Identifier: {text}\nint x;")
    assert set(filter(None, out["labels"].split(","))) == names and out["free_choice"] is free
    prose = licenses.Scanner(licenses.BASE, licenses.NOTICES).scan("dual licensed under whatever terms; the license expression is given")
    assert (prose["labels"], prose["free_choice"]) == ("", None)


def test_no_expression():
    assert [licenses.parse(x) for x in ("", "and", "(", "hello world", ") MIT")] == [None] * 5


def test_random_expressions_agree_with_python():
    random.seed(4)

    def make(depth):
        if not depth or random.random() < 0.3:
            name = random.choice(["mit", "gpl-2.0", "apache-2.0", "lgpl-3.0"])
            return name, {"mit": "True", "apache-2.0": "True"}.get(name, "False")
        (a, x), (b, y), word = make(depth - 1), make(depth - 1), random.choice(["and", "or"])
        return (f"({a} {word} {b})", f"({x} {word} {y})") if random.random() < 0.5 else (f"{a} {word} {b}", f"{x} {word} {y}")

    for _ in range(300):
        text, truth = make(4)
        assert licenses.evaluate(licenses.parse(text))[1] is eval(truth)


def longest_start(text, any_name):
    """The longest start of an expression that a recursive reader accepts, tried from the longest on."""
    written = [t.rstrip(".") for t in re.findall(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*", text)]

    def read(tokens, at, level):
        if level == 3:
            if at < len(tokens) and tokens[at][0] == "(":
                tree, at = read(tokens, at + 1, 0)
                return (tree, at + 1) if tree and at < len(tokens) and tokens[at][0] == ")" else (None, at)
            if at < len(tokens) and tokens[at][1]:
                return ({tokens[at][0]}, at + 1)
            return None, at
        tree, at = read(tokens, at, level + 1)
        while tree and at < len(tokens) and tokens[at][0] == ("or", "and", "with")[level]:
            more, at = read(tokens, at + 1, level + 1)
            if not more:
                return None, at
            tree = tree if level == 2 else tree | more
        return tree, at

    def name(i):
        t, before = written[i], next((x for x in written[:i][::-1] if x != "("), "")
        if t.lower() in ("and", "or", "with", "(", ")"):
            return False
        if next((x.lower() for x in written[:i][::-1]), "") == "with":
            return True
        if licenses._IDENTIFIER.fullmatch(t.lower()):
            return True
        return any_name and t.lower() not in ("none", "noassertion") and (before not in ("and", "or", "with") or bool(re.search("[A-Z0-9-]", t)))

    tokens = [(t.lower(), name(i)) for i, t in enumerate(written)]
    for end in range(len(tokens), 0, -1):
        tree, at = read(tokens[:end], 0, 0)
        if tree and at == end:
            return tree
    return None


def test_the_longest_start_that_is_an_expression():
    random.seed(8)
    words = ["MIT", "GPL-2.0", "and", "or", "with", "OR", "(", ")", "(", ")", "prose", "Foo-1", "none", "Apache-2.0."]
    for _ in range(20_000):
        text = " ".join(random.choices(words, k=random.randint(1, 12)))
        any_name = random.random() < 0.5
        want, got = longest_start(text, any_name), licenses.parse(text, any_name)
        assert (got and licenses.evaluate(got)[0]) == want, text


@pytest.mark.parametrize(
    "text",
    [
        "SPDX-License-Identifier: " + "word " * 64_000,
        "SPDX-License-Identifier: MIT and mit " * 10_000,
        "license expression: (" * 10_000,
        "SPDX-License-Identifier: " + "(" * 60_000,
        "SPDX-License-Identifier: " + " AND ".join(f"A-{i}" for i in range(30_000)),
        "license expression " + "mit or " * 60_000,
    ],
)
def test_long_lines_take_linear_time(text):
    scanner = licenses.Scanner(licenses.BASE, licenses.NOTICES)
    start = time.process_time()
    scanner.scan(text)
    assert time.process_time() - start < 5
