"""WARC records in ZIP packages, written from pages and read back by ranges.

A package is a ZIP file with two stored members: the archive, whose records are compressed one by one, and an index
with the place of each record. Spark writes a package as one line of a text file, so it is on any store that Spark
writes to and a lost executor can't leave half of one; the line's end is the package's comment. A reader needs the
directory and the index, then reads each record where it lies.

Of records with equal payloads (of at least `least` bytes) the one with the smallest page_id is a response, and others
are revisits, which name it and have no payload; smaller payloads are all responses. Payloads are equal if their
lengths and SHA-256 are. A payload that at least one of HEAVY records has is looked up in a broadcast table, which has
at most HEAVY rows however large the input is; others are met by a join.

A null html is an empty payload. Rows that repeat the smallest page_id of their payload are all responses. A null
page_id is larger than any other; where all of a payload's are null, all are responses. A null url is left out, and
characters that a header can't hold are escaped. Other columns aren't read. An empty table gives packages without
records, or none.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burdenflow.llm.slices import map_slices
from burdenflow.llm.store import keep
from burdenflow.llm.zip_archives import Package, package_bytes

#: Bytes of records after which a package is closed.
PACKAGE = 16_000_000
#: A payload that more than one of so many records has is common.
HEAVY = 10_000
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Pages carry no time of their own.
DATE = "1970-01-01T00:00:00Z"
_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _header_value(text: str) -> str:
    """Without spaces and control characters, which unquote() brings back."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c in "%\x7f" else c for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with the payload, or a revisit of another page's."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_name(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else _header_value(url),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Refers-To": record_name(refers_to) if revisit else None,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(body)),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of a record, headers of the answer in it, and the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    body = rest[: int(headers["Content-Length"])]
    if len(body) != int(headers["Content-Length"]) or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError(f"record {headers.get('WARC-Record-ID')} isn't whole")
    top, _, payload = body.partition(b"\r\n\r\n")
    return headers, dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:]), payload


def with_first_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html (text, never null) and refers_to: the page whose payload the row repeats, if it does.

    Only keys are grouped and looked up; the rows themselves move once.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    bytes_ = F.col("html").cast("binary")
    key = F.when(F.octet_length(bytes_) >= least, F.sha2(bytes_, 256))
    equal = rows.select("page_id", key.alias("key")).filter("key is not null").groupBy("key")
    equal = equal.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    equal = keep(equal, "equal-payloads")
    total = rows.count()
    common = equal.filter(F.col("n") * HEAVY >= total)  # at most HEAVY rows
    common = common.select(F.col("key").alias("common_key"), F.col("first").alias("common_first"))
    marked = rows.withColumn("key", key).join(F.broadcast(common), F.col("key") == F.col("common_key"), "left")
    # rows that are settled get a key of their own, so that they don't meet in one partition
    own = F.concat(F.lit("own "), F.coalesce("key", F.lit("")), F.lit(" "), F.xxhash64("page_id", "url").cast("string"))
    marked = marked.withColumn("key", F.when(F.col("common_key").isNull() & F.col("key").isNotNull(), F.col("key")).otherwise(own))
    rare = equal.filter(F.col("n") * HEAVY < total).select("key", "first")
    first = F.coalesce("common_first", "first")
    found = marked.join(rare, "key", "left")
    return found.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(first), first).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, least: int = 0, package: int = PACKAGE, zip64: bool | None = None) -> None:
    """Write a record for each row page_id, url, html into packages in the folder."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records, lines, size, number = [], [], 0, 0

        def frame():
            # the last byte is the line's end, which Spark adds
            data = package_bytes({ARCHIVE: b"".join(records), INDEX: "".join(lines).encode()}, zip64, comment=1)
            return pd.DataFrame({"package": [f"{TaskContext.get().partitionId()}-{number}"], "data": [data]})

        for batch in batches:
            for page_id, url, html, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"]):
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                press = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = press.compress(record(page_id, url, html.encode(), refers_to)) + press.flush()
                entry = {"url": url, "filename": ARCHIVE, "offset": str(size), "length": str(len(data))}
                lines.append(f"{record_name(page_id)} {DATE} {json.dumps(entry)}\n")
                records.append(data)
                size += len(data)
                if size >= package:
                    yield frame()
                    records, lines, size, number = [], [], 0, number + 1
        if records:
            yield frame()

    rows = map_slices(with_first_pages(pages, least), packed, "package string, data binary")
    # the bytes go out as they are: a cast from binary to string doesn't change them
    lines = rows.select("package", F.col("data").cast("string").alias("value"))
    lines.write.option("lineSep", "\n").option("compression", "none").partitionBy("package").text(folder)


def read_index(package: Package) -> Iterator[tuple[str, int, int]]:
    """Archive member, offset and length of every record that the package's indexes name."""
    for name in package.members:
        if name.startswith("indexes/") and name.endswith(".cdxj"):
            for line in package.whole(name).decode().split("\n"):
                if line:
                    entry = json.loads(line.split(" ", 2)[2])
                    yield entry["filename"], int(entry["offset"]), int(entry["length"])


def records_of(package: Package) -> Iterator[tuple]:
    """Every record of a package, read where it lies; a response's payload is held against its digest."""
    for name, offset, length in read_index(package):
        headers, answer, payload = parse_record(zlib.decompress(package.range(name, offset, length), 31))
        kind, known = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and digest(payload) != known:
            raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
        url = headers.get("WARC-Target-URI")
        size = len(payload) if kind == "response" else int(answer["Content-Length"])
        yield (
            _page(headers["WARC-Record-ID"]), None if url is None else unquote(url), kind, size, known,
            _page(headers.get("WARC-Refers-To")), payload if kind == "response" else None,
        )


def read_records(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the packages in a folder: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload."""
    schema = _RECORD if payloads else _RECORD.rsplit(", ", 1)[0]
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
        for batch in batches:
            for value in batch.column("content"):
                data = memoryview(value.as_buffer())
                rows, size = [], 0
                for row in records_of(Package(lambda at, n, data=data: bytes(data[at : at + n]), len(data))):
                    rows.append(row[: len(names)])
                    size += row[3]
                    if size >= PACKAGE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(read, schema)
