"""Token ids, their files and their packing, against the tokenizers library and brute force."""

import itertools
import random
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from burdenflow.llm import packing, token_planes, tokens
from burdenflow.llm.store import new_folder
from burdenflow.llm.tokens import default_vocabulary, encoder

SCHEMA = "doc_id long, text string, start int, parts string"
TEXTS = [
    None, "", " ", "a  b\n\n c", "It's 12³ o'clock,\tthe\xa0end <|endoftext|>. ", "über naïve Wörter! x²", "日本語 text end",
    "word " * 3000, "z" * 5000, "same", "same", "\n", " lead", "trail ", "!!??!! a.b.c. 'tis don't we'll", "tab\t x\x1c y\x85 z",
]


@cache
def library():
    return Tokenizer.from_file(default_vocabulary())


def ids_of(text, end):
    return library().encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_pieces_give_the_ids_of_whole_texts():
    random.seed(7)
    letters = list("ab1.é,_×ª/\n\t  \x1c\x85 'sß你²") + ["<|endoftext|>", " ", "  "]
    own = encoder(default_vocabulary())
    texts = TEXTS + ["".join(random.choices(letters, k=random.randint(0, 25))) for _ in range(4000)]
    want = [ids_of(text, 2) for text in texts]
    assert [np.frombuffer(own.encode(text, 2), "<u4").tolist() for text in texts] == want
    assert [np.frombuffer(ids, "<u4").tolist() for ids in own.encode_all(texts, 2)] == want


def test_groups_of_texts_give_the_ids_of_whole_texts(monkeypatch):
    """Texts with single spaces and line ends, words of all lengths, signs after them; small groups, a memory that overflows."""
    random.seed(8)
    words = ["don't", "I'll", "x²", "5€", "a.b", "é", "日本語", "w" * 23, "w" * 24, "w" * 25, "Straße", "'", "...", "1.5", "", *(f"v{i}" for i in range(300))]
    stops = ["", "", "", ".", ",", "!", "!!", ".'", "$$$"]
    texts = ["".join(random.choice(words) + random.choice(stops) + random.choice("   \n") for _ in range(random.randrange(40))) for _ in range(600)]
    texts += [text.strip().replace("  ", " ") for text in texts] + [random.choice(TEXTS) for _ in range(50)]
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    for group in (1, 500, 10**6):
        monkeypatch.setattr(tokens, "GROUP", group)
        own = tokens.Encoder(default_vocabulary())
        assert [np.frombuffer(ids, "<u4").tolist() for ids in own.encode_all(texts, 1)] == [ids_of(text, 1) for text in texts]


def test_most_pieces_of_a_large_vocabulary_are_encoded_once(monkeypatch):
    words = ["".join(letters) for letters in itertools.islice(itertools.product("etaoinshrdlu", repeat=6), 320_000)]
    texts = [" ".join(words[at : at + 1000]) for at in range(0, len(words), 1000)]
    own, calls = tokens.Encoder(default_vocabulary()), []
    monkeypatch.setattr(own, "_coded", lambda word, found=own._coded: calls.append(1) or found(word))
    first = list(own.encode_all(texts, 1))
    before = len(calls)
    assert list(own.encode_all(texts, 1)) == first
    assert len(calls) - before < 0.6 * before
    assert np.frombuffer(first[7], "<u4").tolist() == ids_of(texts[7], 1)


@pytest.mark.parametrize("places", [1, 16, 1 << 12])
def test_pieces_that_take_each_others_places(monkeypatch, places):
    random.seed(9)
    words = ["a", "a\0", "a\0\0", "é", "x" * 30, "qzxjkvwpqzxjkvwp", "ﷺ" * 7, ".", "b,", "don't", "1.5", "\U0001f9ff" * 5, *(f"v{i}" for i in range(60))]
    texts = [" ".join(random.choices(words, k=random.randrange(1, 60))) for _ in range(80)]
    monkeypatch.setattr(tokens, "PLACES", places, raising=False)
    monkeypatch.setattr(tokens, "GROUP", 700)
    own = tokens.Encoder(default_vocabulary())
    for _ in range(2):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in own.encode_all(texts, 1)] == [ids_of(text, 1) for text in texts]


def test_added_tokens_are_tokens():
    text = "a <|endoftext|> b"
    assert ids_of(text, 1) == [64, 220, 50256, 275, 1] == np.frombuffer(encoder(default_vocabulary()).encode(text, 1), "<u4").tolist()


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("n", [1, 7, 4096])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    planes = token_planes.to_planes(ids, kind)
    assert len(planes) == {"bit": 32, "byte": 4}[kind]
    assert (token_planes.from_planes(planes, kind, n) == ids).all()


@pytest.mark.parametrize("kind,block", [("byte", 64), ("bit", 1000)])
def test_files_give_back_every_document(spark, kind, block):
    rows = [(i, t, 0, "") for i, t in enumerate(TEXTS)] + [(None, "no id", 1, ""), (3, "a  b\n\n c", 1, "")]
    folder = new_folder(spark, "test-planes")
    token_planes.write_tokens(frame(spark, rows), folder, default_vocabulary(), 2, block=block, kind=kind, shards=3)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for doc_id, text, *_ in rows:
        ids = ids_of(text, 2)
        want.append((doc_id, at, len(ids), ids))
        at += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in token_planes.read_tokens(spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    digests = token_planes.token_digests(spark, folder).collect()
    assert sorted(map(tuple, digests), key=lambda r: r[1]) == [(d, s, n, crc(ids)) for d, s, n, ids in want]
    sizes = token_planes.read_blocks(spark, folder).select("n", "block", "shard").collect()
    assert max(r.n for r in sizes) <= block


def test_files_of_an_empty_table(spark):
    folder = new_folder(spark, "test-planes")
    token_planes.write_tokens(frame(spark, []), folder, default_vocabulary(), 2)
    assert token_planes.read_tokens(spark, folder).count() == 0
    assert token_planes.token_digests(spark, folder).count() == 0


def padding(length, window):
    return 0 if length & (length - 1) == 0 else window - length


@pytest.mark.parametrize("window", [16, 2048])
def test_pieces_cover_every_document_once_without_gaps(spark, window):
    rows = [(i, t, 0, "") for i, t in enumerate(TEXTS)]
    got = packing.pack(frame(spark, rows), default_vocabulary(), 1, window).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc_id, text, *_ in rows:
        ids, at = ids_of(text, 1), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and padding(at, window) == 0


def test_pieces_of_repeated_rows_and_empty_tables(spark):
    got = packing.pack(frame(spark, [(1, "a b c", 0, "")] * 5 + [(None, None, 0, "")]), default_vocabulary(), 1).collect()
    assert sum(r.length for r in got) == 5 * 4 + 1
    assert packing.pack(frame(spark, []), default_vocabulary(), 1).count() == 0


def test_a_part_goes_where_the_squares_are_smallest():
    random.seed(5)
    packer = packing.Packer(32)
    for number in range(3000):
        size, before = random.randint(1, 31), packer.counts.copy()
        packer.add(number, size)

        def squares(level):
            counts = before.copy()
            if level:
                counts[level] -= 1
            if level + size < 32:
                counts[level + size] += 1
            return int((counts[1:32] ** 2).sum())

        best = min(squares(level) for level in range(33 - size) if not level or before[level])
        assert int((packer.counts[1:32] ** 2).sum()) == best
        assert all(len(packer.open[level]) == packer.counts[level] for level in range(1, 32))


def test_clashing_names_are_ignored(spark):
    docs = frame(spark, [(1, "a b", 7, "x")]).withColumn("length", F.lit("y")).withColumn("ids", F.lit(1))
    assert packing.pack(docs, default_vocabulary(), 1).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
