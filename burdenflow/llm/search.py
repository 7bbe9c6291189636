"""Exact search for the k largest inner products, by tiled matrix products.

Candidates become shards, queries become tiles: matrices of a bounded number of rows. The queries are dealt out to some
groups and the candidates to others, and a cell, one group of each, is a task: it holds its queries with their k best
rows so far and reads its shards one after the other. Every tile meets every shard once, in one matrix product, of which
only what beats a query's k-th best row so far is looked at. So a cell hands on one list for each query, however many
shards it has read. The lists of a query are then merged as a tree, a fixed number at a time, so no task sees more than
that number of lists of k. There are as many cells as a shuffle has partitions, fewer for small tables, cut so that few
copies of rows are made; more where the queries of a cell would be too many to be held.

Components are turned into whole numbers floor(scale * x) first; one too large for a double after scaling counts as the
largest double. Products and sums are exact in single precision where the lengths of two vectors multiply to less
than 2**24 and in double precision below 2**52, which is checked; the products of other pairs are formed again in whole numbers of any size. A score beyond
63 bits counts as the nearest number of 63 bits. The rest of the row is not read.

Vectors that are null or hold null, infinite or not-a-number components take no part, nor do empty ones. Queries
meet candidates of the same length only. Ties go to the smaller vec_id. Rows with the query's own vec_id are no
candidates of it; a vec_id that several query rows share is searched once, for the smallest of its vectors, while
repeated candidate rows are candidates each. Rows without vec_id take no part. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from burdenflow.llm.store import keep, release, width

SHARD, TILE, FAN = 2_048, 256, 16
#: Numbers of a matrix at most (a row is never cut), and bytes of queries and their best rows that a cell may hold.
NUMBERS, HELD = 2**20, 64 * 2**20
_LARGEST, _MOST = float(np.finfo(float).max), 2**63 - 1
_NONE = -(2**63)
_KINDS = (("<i1", 2**7 - 1), ("<i2", 2**15 - 1), ("<i4", 2**31 - 1))
_MATRIX = "dim int, kind string, ids binary, matrix binary"
#: The k best rows of a tile's queries, as matrices, out of what a node of the tree has met.
_TILE = ["dim", "query_group", "tile"]
_LISTS = "dim int, query_group int, tile int, node int, ids binary, scores binary, found binary"
_HITS = "query_id long, rank int, vec_id long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector of doubles for the rows that take part."""
    doubles = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return doubles.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", fine))


def whole(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and vector of whole numbers (as doubles) for the rows that take part."""
    # from 2**53 on every double is a whole number
    large = lambda x: F.greatest(F.least(x, F.lit(_LARGEST)), F.lit(-_LARGEST))
    floor = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(large(x))
    return usable(vectors).select("vec_id", F.transform("vector", lambda x: floor(x * scale)).alias("vector"))


def _stack(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Rows of vec_id and vector as matrices of at most `most` rows each, by length, of the shortest numbers that do."""
    held: dict[int, list] = {}
    numbers = 0

    def row(dim):
        rows = held.pop(dim)
        matrix = np.stack([r[1] for r in rows])
        top = np.abs(matrix).max()
        kind = next((kind for kind, largest in _KINDS if top <= largest), "<f8")
        return dim, kind, np.array([r[0] for r in rows], "<i8").tobytes(), matrix.astype(kind).tobytes()

    def table(done):
        return pd.DataFrame(done, columns=["dim", "kind", "ids", "matrix"])

    for batch in batches:
        done = []
        for key, vector in zip(batch["vec_id"], batch["vector"]):
            dim = len(vector)
            held.setdefault(dim, []).append((key, np.asarray(vector, float)))
            numbers += dim
            if len(held[dim]) >= min(most, max(1, NUMBERS // dim)):
                numbers -= dim * len(held[dim])
                done.append(row(dim))
            elif numbers > 4 * NUMBERS:
                done += [row(dim) for dim in list(held)]
                numbers = 0
        if done:
            yield table(done)
    if held:
        yield table([row(dim) for dim in list(held)])


def matrices(vectors: DataFrame, most: int) -> DataFrame:
    return vectors.mapInPandas(lambda batches: _stack(batches, most), _MATRIX)


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", rows, rows))


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact up to 63 bits; larger ones count as the nearest of 63 bits."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (left @ right.T).astype(np.int64)
        a, b = _lengths(left), _lengths(right)
        unsure = np.flatnonzero(~(a * b.max(initial=0.0) < 2.0**52))
    # a row at a time, and of it only the candidates that are too long for it
    for i in unsure:
        with np.errstate(over="ignore", invalid="ignore"):
            places = np.flatnonzero(~(a[i] * b < 2.0**52))
        used = np.flatnonzero(left[i])
        row = [int(x) for x in left[i, used]]
        for j in places:
            score = sum(x * int(y) for x, y in zip(row, right[j, used]))
            out[i, j] = max(-_MOST, min(_MOST, score))
    return out


class Best:
    """The k best rows of some queries: by score, then by vec_id; where there are fewer, _NONE stands last."""

    def __init__(self, ids: np.ndarray, scores: np.ndarray, found: np.ndarray):
        self.ids, self.scores, self.found, self.k = ids, scores, found, scores.shape[1]

    def add(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        better = (score > self.scores[query, -1]) | (score == self.scores[query, -1]) & (row < self.found[query, -1])
        better &= row != self.ids[query]
        query, score, row = query[better], score[better], row[better]
        if not len(query):
            return
        touched = query[np.diff(query, prepend=-1) > 0]
        query = np.concatenate([query, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.scores[touched].ravel()])
        row = np.concatenate([row, self.found[touched].ravel()])
        order = np.lexsort((row, ~score, query))
        starts = np.flatnonzero(np.diff(query[order], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
        kept = order[rank < self.k]
        self.scores[touched], self.found[touched] = score[kept].reshape(-1, self.k), row[kept].reshape(-1, self.k)

    def join(self, scores: np.ndarray, found: np.ndarray) -> None:
        """The best rows that another node of the tree has for the same queries."""
        scores, found = np.hstack([self.scores, scores]), np.hstack([self.found, found])
        order = np.lexsort((found, ~scores))[:, : self.k]
        self.scores, self.found = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)

    def bytes(self) -> tuple[bytes, bytes, bytes]:
        return self.ids.tobytes(), self.scores.tobytes(), self.found.tobytes()


class Tile(Best):
    """Queries with their vectors and their best rows so far."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        super().__init__(ids, np.full((len(ids), k), _NONE, np.int64), np.full((len(ids), k), _MOST, np.int64))
        self.matrix, self.longest = matrix, _longest(matrix)

    def meet(self, ids: np.ndarray, rows: np.ndarray, longest: float) -> None:
        """Rows of candidates; `longest` is the length of the longest."""
        if max(self.longest, longest, self.longest * longest) < 2.0**24:
            scores = self.matrix.astype("f4") @ rows.astype("f4", copy=False).T
        else:
            scores = inner_products(self.matrix.astype(float), rows.astype(float))
        # few candidates at first, so that there is a k-th best row to beat
        at, step = 0, len(ids) if (self.scores[:, -1] > _NONE).all() else max(32, 2 * self.k)
        while at < len(ids):
            some = scores[:, at : at + step]
            floor = self.scores[:, -1].astype(some.dtype)
            # most queries have nothing to look at
            queries = np.flatnonzero(some.max(axis=1) >= floor)
            some = some[queries]
            query, place = np.divmod(np.flatnonzero(some >= floor[queries, None]), some.shape[1])
            self.add(queries[query], some[query, place].astype(np.int64), ids[at + place])
            at, step = at + step, 2 * step


def _longest(matrix: np.ndarray) -> float:
    with np.errstate(over="ignore"):
        return float(_lengths(matrix.astype(float)).max(initial=0.0))


def _cells(batches: Iterator[pa.RecordBatch], k: int, shard: int, tile: int) -> Iterator[tuple]:
    """The lists of every cell; its tiles come first, in the same order in all cells of a group, then its shards."""
    tile = min(tile, max(1, NUMBERS // k))
    cell, asked, tiles, shards = None, [], [], []

    def meet():
        if not shards:
            return
        if asked:
            ids, matrix = (np.concatenate(x) for x in zip(*asked))
            asked.clear()
            tiles.extend(Tile(ids[at : at + tile], matrix[at : at + tile], k) for at in range(0, len(ids), tile))
        ids, rows = (np.concatenate(x) for x in zip(*shards))
        shards.clear()
        # in order of vec_id, so that of equal scores the first stay
        order = np.argsort(ids, kind="stable")
        longest = _longest(rows)
        ids, rows = ids[order], rows[order].astype("f4" if longest < 2.0**24 else "f8")
        for one in tiles:
            one.meet(ids, rows, longest)

    def lists():
        meet()
        for at, one in enumerate(tiles):
            yield cell[0], cell[1], at, cell[2], *one.bytes()
        asked.clear(), tiles.clear()

    for batch in batches:
        columns = {name: batch.column(name) for name in batch.schema.names}
        for at in range(batch.num_rows):
            key = tuple(columns[name][at].as_py() for name in ("dim", "query_group", "group"))
            if key != cell:
                yield from lists()
                cell = key
            ids = np.frombuffer(columns["ids"][at].as_buffer(), "<i8")
            matrix = np.frombuffer(columns["matrix"][at].as_buffer(), columns["kind"][at].as_py()).reshape(-1, key[0])
            (shards if columns["is_shard"][at].as_py() else asked).append((ids.copy(), matrix.copy()))
            if sum(len(x) for x, _ in shards) >= min(shard, max(1, NUMBERS // key[0])):
                meet()
    yield from lists()


def _joined(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[tuple, Best]]:
    """The lists of a tile and a node, which come one after the other, as one."""
    key = best = None
    for batch in batches:
        columns = {name: batch.column(name) for name in batch.schema.names}
        for at in range(batch.num_rows):
            ids, scores, found = (np.frombuffer(columns[name][at].as_buffer(), "<i8").copy() for name in ("ids", "scores", "found"))
            its = tuple(columns[name][at].as_py() for name in (*_TILE, "node"))
            if its != key:
                if best:
                    yield key, best
                key, best = its, Best(ids, scores.reshape(-1, k), found.reshape(-1, k))
            else:
                best.join(scores.reshape(-1, k), found.reshape(-1, k))
    if best:
        yield key, best


def grid(vectors: DataFrame, is_query: Column, k: int, shard: int, tile: int, cells: int) -> DataFrame:
    """For every length that queries have, the numbers of groups of queries and of candidates.

    With about `cells` cells the fewest copies are made where there are sqrt(cells * queries / candidates) groups of
    queries; more are needed where the queries of a cell would be more than it may hold.
    """
    sizes = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).filter("size(vector) > 0")
    counted = sizes.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("rows"), F.count(F.when(is_query, 1)).alias("asked"))
    must = F.ceil(F.col("asked") * (8 * F.col("dim") + 16 * k) / HELD)
    wanted = F.round(F.sqrt(cells * F.col("asked") / F.col("rows")))
    queries = F.least(F.ceil(F.col("asked") / tile), F.greatest(must, wanted, F.lit(1)))
    groups = F.greatest(F.lit(1), F.least(F.ceil(F.col("rows") / shard), F.floor(F.lit(cells) / F.col("query_groups"))))
    counted = counted.filter("asked > 0").withColumn("query_groups", queries.cast("int"))
    return counted.withColumn("groups", groups.cast("int")).select("dim", "query_groups", "groups")


def search(vectors: DataFrame, is_query: Column, k: int, scale: int = 256, shard: int = SHARD, tile: int = TILE, fan: int = FAN) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every query."""
    spread = width(vectors.sparkSession)
    groups = keep(grid(vectors, is_query, k, shard, tile, spread), "search-groups")
    rows = whole(vectors, scale)
    asked = rows.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    numbered = lambda blocks: blocks.withColumn("block", F.monotonically_increasing_id())
    # written, so that every copy of a tile is the same
    tiles = keep(numbered(matrices(asked, tile)), "search-tiles")

    def copies(blocks: DataFrame, is_shard: bool) -> DataFrame:
        """Blocks with the cells that they belong to: a tile to all of its group of queries, a shard to all of its own."""
        names = {"query_group": "query_groups", "group": "groups"}
        own, all_of = ("group", "query_group") if is_shard else ("query_group", "group")
        dealt = blocks.join(F.broadcast(groups), "dim").withColumn(own, F.pmod(F.xxhash64("block"), F.col(names[own])).cast("int"))
        dealt = dealt.withColumn(all_of, F.explode(F.sequence(F.lit(0), F.col(names[all_of]) - 1)))
        first = F.pmod(F.xxhash64("dim"), F.lit(spread)).cast("int")
        part = F.pmod(first + F.col("query_group") * F.col("groups") + F.col("group"), F.lit(spread)).cast("int")
        return dealt.select("dim", "query_group", "group", F.lit(is_shard).alias("is_shard"), "block", "kind", "ids", "matrix", part.alias("part"))

    blocks = copies(tiles, False).unionByName(copies(numbered(matrices(rows, shard)), True))
    blocks = blocks.repartitionById(spread, "part").drop("part").sortWithinPartitions("dim", "query_group", "group", "is_shard", "block")
    kinds = to_arrow_schema(StructType.fromDDL(_LISTS))

    def written(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds.types)], schema=kinds)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return written(_cells(batches, k, shard, tile))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return written((*key, *best.bytes()) for key, best in _joined(batches, k))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for _, best in _joined(batches, k):
            at, place = np.nonzero(best.scores > _NONE)
            frame = {"query_id": best.ids[at], "rank": place + 1, "vec_id": best.found[at, place], "score": best.scores[at, place]}
            yield pa.RecordBatch.from_arrays([pa.array(frame[x.name], x.type) for x in shown], schema=shown)

    shown = to_arrow_schema(StructType.fromDDL(_HITS))
    lists = blocks.mapInArrow(products, _LISTS)
    slots = groups.select(F.max("groups")).first()[0] or 1
    while slots > 1:
        slots = -(-slots // fan)
        lists = lists.withColumn("node", F.floor(F.col("node") / fan).cast("int")).repartition(*_TILE, "node")
        lists = lists.sortWithinPartitions(*_TILE, "node").mapInArrow(joined, _LISTS)
    found = keep(lists.mapInArrow(hits, _HITS), "search-results")
    release(groups)
    release(tiles)
    return found
