"""Every query of the package over its whole table, against brute force over the same rows."""

import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from __spark_entry__ import oracle_sql, queries
from burdenflow.llm.queries import ORACLE, REGISTRY
from check import TABLES, bag, unlike
from tests.llm import test_licenses, test_mixing, test_near_copies, test_quality, test_spots
from tests.llm.test_tokens import library

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not found")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").collect()


def run(spark, start):
    name = next(n for n in REGISTRY if n.startswith(start))
    return queries()[name](spark, FOLDER)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(text, end):
    return library().encode(text or "", add_special_tokens=False).ids + [end]


def test_each_operator_has_a_query():
    assert [sum(n.startswith(f"op{k}_") for n in REGISTRY) for k in range(1, 14)] == [1] * 13
    assert set(REGISTRY) | {"pipeline"} <= set(queries()) and set(ORACLE) <= set(oracle_sql())


def test_check_sql(spark):
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    for name, sql in ORACLE.items():
        df = queries()[name](spark, FOLDER)
        cursor = con.execute(sql)
        assert not unlike(df, cursor.description)
        assert bag(df.columns, df.collect()) == bag([c[0] for c in cursor.description], cursor.fetchall())


def test_op1(spark, documents):
    got, at = sorted(run(spark, "op1_").collect(), key=lambda r: r.doc_id), 0
    for r, d in zip(got, sorted(documents, key=lambda d: d.doc_id), strict=True):
        ids = encoded(d.text, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), crc(ids))
        at += len(ids)


def test_op2(spark, documents):
    got = sorted(((r.doc_id, r.class_id) for r in run(spark, "op2_").collect()), key=repr)
    assert got == test_near_copies.brute([(d.doc_id, d.text) for d in documents])


def test_op3(spark, documents, monkeypatch):
    from burdenflow.llm import spots

    anchors = spots.anchors_of(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    monkeypatch.setattr(test_spots, "ANCHORS", anchors)
    assert test_spots.mine(run(spark, "op3_")) == test_spots.brute([(d.doc_id, d.text) for d in documents])


def test_op4(spark, documents):
    got, sizes = run(spark, "op4_").collect(), {}
    source = {d.doc_id: d.source for d in documents}
    for d in documents:
        sizes[d.source] = sizes.get(d.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
    want, taken = test_mixing.targets(sizes), {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s] = taken.get(s, 0) + r.taken
    assert len(got) == len(documents) and all(abs(taken[s] - want[s]) <= 0.03 * sizes[s] for s in taken)


@pytest.mark.parametrize("start,folds,held,cut", [("op5_", 5, 0, 0.5), ("op10_", 4, 2, 0.7)])
def test_scores(spark, documents, start, folds, held, cut):
    got = run(spark, start).collect()
    assert sorted(r.doc_id for r in got) == sorted(d.doc_id for d in documents)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)


def test_op10_scores_are_those_of_brute_force(spark, documents):
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()]
    want = test_quality.brute_scores([(d.doc_id, d.text) for d in documents], labels, 4, 2, 0.7)
    got = {r.doc_id: r for r in run(spark, "op10_").collect()}
    assert got.keys() == want.keys()
    for i, score in want.items():
        assert got[i].score == pytest.approx(score, abs=2e-3)
        assert got[i].predicted == (score >= 0.7) or abs(score - 0.7) < 2e-3


def test_op7(spark, documents):
    texts = {d.doc_id: d.text for d in documents}
    got = run(spark, "op7_").collect()
    assert len(got) == len(documents)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == test_licenses.brute(texts[r.doc_id])


def test_op8(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = run(spark, "op8_").collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article).replace("<br>", " "))
        want = "\n\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)
        assert r.text == want and r.n_chars == len(want)


def test_op9(spark, documents):
    pieces, fills = {}, {}
    for r in run(spark, "op9_").collect():
        pieces.setdefault(r.doc_id, []).append(r)
        fills.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d in documents:
        ids, at = encoded(d.text, 1), 0
        for r in sorted(pieces[d.doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for parts in fills.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
