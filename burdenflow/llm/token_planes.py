"""Token ids in files of compressed planes.

A file holds a shard: the ids of its documents one after another, in ascending doc_id order, cut into blocks
of a fixed number of ids. A block is transposed into byte planes (plane k: byte k of every id) or bit planes
(plane k: bit k of every id), each compressed with zstandard. Beside its planes a block has its place in the
shard and the parts of documents in it, so the index can be read without touching a plane. Files are Parquet,
which any store that Spark writes to can hold and which a lost executor cannot leave half written.

Null texts are empty ones; an empty text has only the end id. Rows with equal doc_id follow each other in the
order of their texts. A null doc_id sorts first. Other columns of the input are not read. An empty table gives
files without blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burdenflow.llm.store import width
from burdenflow.llm.tokens import encoder

BLOCK = 65_536
SCHEMA = (
    "shard int, block long, first long, n long, kind string, planes array<binary>, "
    "parts array<struct<doc_id: long, doc_at: long, doc_tokens: long, part_start: long, length: long>>"
)
PART = "shard int, doc_id long, doc_at long, doc_tokens long, part_start long, length long, ids binary"


def to_planes(ids: np.ndarray, kind: str, level: int = 3) -> list[bytes]:
    """Planes of one block of unsigned 32-bit ids, each compressed."""
    import zstandard

    table = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        rows = np.packbits(np.unpackbits(table, axis=1, bitorder="little").T, axis=1, bitorder="little")
    elif kind == "byte":
        rows = np.ascontiguousarray(table.T)
    else:
        raise ValueError(f"planes are 'bit' or 'byte', not {kind!r}")
    press = zstandard.ZstdCompressor(level=level)
    return [press.compress(row.tobytes()) for row in rows]


def from_planes(planes: list[bytes], kind: str, n: int) -> np.ndarray:
    """The block of n ids that to_planes() was given."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    rows = np.stack([np.frombuffer(press.decompress(bytes(p), max_output_size=max(1, 4 * n)), np.uint8) for p in planes])
    if kind == "bit":
        bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
        return np.packbits(bits.T, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.ascontiguousarray(rows.T).reshape(-1).view("<u4")


def write_tokens(
    docs: DataFrame, folder: str, vocabulary: str, end: int, block: int = BLOCK, kind: str = "byte", shards: int | None = None
) -> None:
    """Encode the texts, add the end id to each and write them to the folder in ascending doc_id order."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_all, shard = encoder(vocabulary).encode_all, TaskContext.get().partitionId()
        held, parts, room, number, at = [], [], block, 0, 0

        def row():
            ids = np.frombuffer(b"".join(held), "<u4")
            return shard, number, number * block, len(ids), kind, to_planes(ids, kind), list(parts)

        names = ["shard", "block", "first", "n", "kind", "planes", "parts"]
        for batch in batches:
            done = []
            for doc_id, ids in zip(batch["doc_id"], encode_all(batch["text"], end)):
                n, start = len(ids) // 4, 0
                while start < n:
                    length = min(room, n - start)
                    held.append(ids[4 * start : 4 * (start + length)])
                    key = None if pd.isna(doc_id) else int(doc_id)
                    parts.append({"doc_id": key, "doc_at": at, "doc_tokens": n, "part_start": start, "length": length})
                    start, room = start + length, room - length
                    if not room:
                        done.append(row())
                        held, parts, room, number = [], [], block, number + 1
                at += n
            if done:
                yield pd.DataFrame(done, columns=names)
        if parts:
            yield pd.DataFrame([row()], columns=names)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = narrow.repartitionByRange(shards or width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInPandas(blocks, SCHEMA).write.option("compression", "uncompressed").parquet(folder)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, list]]:
    """Each block with its parts and their ids."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            ids, at, out = from_planes(row.planes, row.kind, row.n), 0, []
            for p in row.parts:
                out.append((p, ids[at : at + p["length"]].tobytes()))
                at += p["length"]
            yield row, out


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Number of ids in the shards before each shard, from the index alone: one row for each shard."""
    sizes = read_blocks(spark, folder).groupBy("shard").agg(F.sum("n").alias("shard_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("shard_ids").over(before), F.lit(0)).alias("shard_start"))


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of documents with their ids (unsigned 32-bit, little-endian), one row for each block they lie in."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, parts in _parts(batches):
            yield pd.DataFrame([(row.shard, *(p[c] for c in ("doc_id", "doc_at", "doc_tokens", "part_start", "length")), ids) for p, ids in parts], columns=[x.split()[0] for x in PART.split(", ")])

    return read_blocks(spark, folder).mapInPandas(unpack, PART)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document, parts of one document put together."""
    parts = read_parts(spark, folder).groupBy("shard", "doc_at", "doc_id", "doc_tokens")
    whole = parts.agg(F.array_sort(F.collect_list(F.struct("part_start", "ids"))).alias("parts")).join(shard_starts(spark, folder), "shard")
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return whole.select("doc_id", (F.col("shard_start") + F.col("doc_at")).alias("start"), F.col("doc_tokens").alias("n_tokens"), ids.alias("ids"))


def joined_crc32(crcs: list[int], lengths: list[int]) -> int:
    """Checksum of byte strings one after another, from theirs: the sum is linear, so each earlier one is carried over zeros."""
    total = 0
    for crc, length in zip(crcs, lengths):
        zeros = bytes(length)
        total = zlib.crc32(zeros, total) ^ zlib.crc32(zeros) ^ crc
    return total


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files; ids stay in the task that unpacks them."""
    sums = "shard int, doc_id long, doc_at long, doc_tokens long, part_start long, length long, crc long"

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, parts in _parts(batches):
            yield pd.DataFrame(
                [(row.shard, p["doc_id"], p["doc_at"], p["doc_tokens"], p["part_start"], p["length"], zlib.crc32(ids)) for p, ids in parts],
                columns=[x.split()[0] for x in sums.split(", ")],
            )

    @F.pandas_udf("long")
    def together(crcs: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([int(c[0]) if len(c) == 1 else joined_crc32([int(x) for x in c], [4 * int(x) for x in n]) for c, n in zip(crcs, lengths)], dtype="int64")

    parts = read_blocks(spark, folder).mapInPandas(unpack, sums).groupBy("shard", "doc_at", "doc_id", "doc_tokens")
    whole = parts.agg(F.array_sort(F.collect_list(F.struct("part_start", "length", "crc"))).alias("parts")).join(shard_starts(spark, folder), "shard")
    return whole.select(
        "doc_id",
        (F.col("shard_start") + F.col("doc_at")).alias("start"),
        F.col("doc_tokens").alias("n_tokens"),
        together(F.col("parts.crc"), F.col("parts.length")).alias("ids_crc32"),
    )
