"""Packages against the standard library's reader, records against a round trip."""

import base64
import hashlib
import io
import random
import zipfile

import pytest

from burdenflow.llm import web_archives
from burdenflow.llm.store import new_folder
from burdenflow.llm.web_archives import parse_record, read_records, record, write_packages
from burdenflow.llm.zip_archives import Package, package_bytes

PAGES = "page_id long, url string, html string"


def opened(data):
    reads = []

    def read(at, n):
        assert 0 <= at and at + n <= len(data)
        reads.append(n)
        return data[at : at + n]

    package = Package(read, len(data))
    package.reads = reads
    return package


@pytest.mark.parametrize("zip64", [None, False, True])
def test_written_packages(zip64):
    members = {"a/ü.bin": random.Random(1).randbytes(5000), "empty": b"", "PK": b"PK\x05\x06" * 40}
    data = package_bytes(members, zip64, comment=1) + b"\n"
    with zipfile.ZipFile(io.BytesIO(data)) as whole:
        assert {n: whole.read(n) for n in whole.namelist()} == members and whole.testzip() is None
    package = opened(data)
    assert {n: package.whole(n) for n in package.members} == members
    package.reads.clear()
    assert package.range("a/ü.bin", 70, 9) == members["a/ü.bin"][70:79]
    assert sum(package.reads) < 50  # a local header and the range
    with pytest.raises(ValueError, match="no such range"):
        package.range("empty", 0, 1)


def test_packages_of_others():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as whole:
        whole.writestr("stored", b"x" * 100)
        with whole.open("wide", "w", force_zip64=True) as member:
            member.write(b"y" * 100)
        whole.writestr("packed", b"z" * 100, zipfile.ZIP_DEFLATED)
        whole.comment = b"PK\x05\x06 in a comment" + bytes(30)
    package = opened(out.getvalue())
    assert package.whole("stored") == b"x" * 100 and package.whole("wide") == b"y" * 100
    with pytest.raises(ValueError, match="not stored"):
        package.whole("packed")
    with pytest.raises(ValueError, match="not a ZIP package"):
        opened(b"no archive at all" * 10)
    with pytest.raises(ValueError, match="not a ZIP package"):
        opened(b"")


def test_many_members():
    """More members than the old directory can count."""
    members = {f"m{i}": b"%d" % i for i in range(70_000)}
    package = opened(package_bytes(members))
    assert len(package.members) == 70_000 and package.whole("m69999") == b"69999"


def test_damage_is_seen():
    data = bytearray(package_bytes({"a": b"hello"}))
    data[data.index(b"hello")] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        opened(bytes(data)).whole("a")
    with pytest.raises(ValueError, match="isn't whole"):
        parse_record(record(1, "u", b"payload", None)[:-3])


def test_records():
    headers, answer, payload = parse_record(record(5, "http://ü/ %20\r\nX: y", b"a\r\n\r\nb", None))
    assert payload == b"a\r\n\r\nb" and headers["WARC-Target-URI"] == "http://ü/%20%2520%0D%0AX:%20y" and answer["Content-Length"] == "6"
    headers, answer, payload = parse_record(record(None, None, b"abc", 3))
    assert (headers["WARC-Type"], headers["WARC-Refers-To"], answer["Content-Length"], payload) == ("revisit", "<urn:page:3>", "3", b"")
    assert "WARC-Target-URI" not in headers


def pages():
    rng = random.Random(2)
    rows = [(i, f"http://p/{i} ü%41\n", rng.choice(["", "same", "same", "é" * 50, f"<p>{i}\r\n\r\n\x00</p>", None])) for i in range(300)]
    return rows + [(7, "again", rows[7][2]), (None, None, "same"), (None, "n", "only null"), (None, "m", "only null"), (-5, None, "x" * 3_000_000), (-4, "", "x" * 3_000_000)]


def expected(rows, least):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    out = []
    for page_id, url, html in rows:
        data = (html or "").encode()
        refers_to = first.get(html or "") if len(data) >= least else None
        refers_to = None if refers_to == page_id else refers_to
        kind = "response" if refers_to is None else "revisit"
        out.append((page_id, url, kind, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), refers_to, data if refers_to is None else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,heavy,package", [(0, 10_000, 16_000_000), (5, 1, 2000), (0, 3, 1)])
def test_round_trip(spark, monkeypatch, least, heavy, package):
    """All payloads common, few common; packages of many records, of some and of one."""
    monkeypatch.setattr(web_archives, "HEAVY", heavy)
    rows = pages()
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS key", "'x' AS first", "2 AS package", "3 AS refers_to", "4 AS common_key").repartition(3)
    folder = new_folder(spark, "test-archives")
    write_packages(df, folder, least, package)
    found = read_records(spark, folder)
    assert sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in found.collect()), key=str) == expected(rows, least)


def test_empty(spark):
    folder = new_folder(spark, "test-archives")
    write_packages(spark.createDataFrame([], PAGES), folder)
    assert read_records(spark, folder).collect() == []
