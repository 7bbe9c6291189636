"""Ranked lexical search over posting lists with sparse tables of range maxima.

The index is a table of blocks of documents. A block holds, for each of its terms, the documents that have it in
ascending order and how often; it is written by the task that reads the documents, so the texts don't move. All
terms of all documents are in it, so the index serves any queries.

A query is searched in every block, best first, over intervals of documents. The postings of a term inside an
interval are a slice of its list, and a sparse table over the list's impacts answers which of them is largest. Those
maxima, summed over the query's terms, bound every score in the interval. The interval with the highest bound is cut
at the document of its largest impact: that document is scored, and what lies left and right of it goes back. An
interval whose bound lies under the k-th best score so far is dropped. Some intervals are cut at a time, as arrays.

A sixteenth of the blocks (by hash) is searched first; the k-th best score there is a floor for all other blocks,
under which nothing can be among the k best. Queries are searched in batches of a bounded number of terms, which
(with the number of documents of each term) is all that comes to the driver.

Null texts and texts without a term match nothing, nor does a query without terms. Equal scores go by ascending
doc_id, a null doc_id last. Repeated documents are ranked each; repeated queries get a result each. Other columns
aren't read. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burdenflow.llm.slices import map_slices
from burdenflow.llm.store import keep, new_folder

#: A block ends with so many documents, or with so many postings.
DOCUMENTS, POSTINGS = 4096, 1_000_000
#: Terms (of all queries together) that are searched in one pass over the index.
BATCH_TERMS = 200_000
#: Intervals that are cut at a time; one of so many blocks is searched first.
AT_A_TIME, LEAD = 64, 16
#: A null doc_id comes after all others.
LAST = np.iinfo(np.int64).max

#: Terms are runs of digits, Latin letters and bytes outside of ASCII; only A to Z are lower-cased.
_TERM_BYTES = bytes(b | 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

_FOUND = ["item", "key", "doc_id", "score"]
_BLOCK = "block long, lead boolean, filled long, words long, doc_ids binary, lengths binary, terms array<binary>, sizes binary, docs binary, counts binary"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERM_BYTES).split()


class Block:
    """Postings of documents, gathered one after another."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.doc_ids, self.lengths, self.sizes, self.terms, self.counts = [], [], [], [], []

    def add(self, doc_id: int, words: list[bytes]) -> None:
        found = Counter(words)
        self.doc_ids.append(doc_id)
        self.lengths.append(len(words))
        self.sizes.append(len(found))
        self.terms.extend(map(self.vocabulary.__getitem__, found))
        self.counts.extend(found.values())

    def full(self, documents: int) -> bool:
        return len(self.doc_ids) >= documents or len(self.terms) >= POSTINGS

    def row(self, number: int, lead: bool) -> tuple:
        ids, lengths = np.array(self.doc_ids, np.int64), np.array(self.lengths, np.int64)
        order = np.argsort(ids, kind="stable")  # a document's number in the block rises with its doc_id
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        docs, terms = np.repeat(place, self.sizes), np.array(self.terms, np.int64)
        by_term = np.lexsort((docs, terms))
        sizes = np.bincount(terms, minlength=len(self.vocabulary))
        packed = [a.astype("<i4").tobytes() for a in (sizes, docs[by_term], np.array(self.counts, np.int64)[by_term])]
        heads = (ids[order].astype("<i8").tobytes(), lengths[order].astype("<i8").tobytes())
        return number, lead, int((lengths > 0).sum()), int(lengths.sum()), *heads, list(self.vocabulary), *packed


def build_index(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """Write the index of documents doc_id, text to the shared folder and read it back."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _BLOCK.split(", ")]
        block, number = Block(), TaskContext.get().partitionId() << 32

        def frame():
            return pd.DataFrame([block.row(number, hash(number ^ number >> 32) % LEAD == 0)], columns=names)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                block.add(LAST if pd.isna(doc_id) else int(doc_id), terms_of(text))
                if block.full(documents):
                    yield frame()
                    block, number = Block(), number + 1
        if block.doc_ids:
            yield frame()

    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "postings")
    index = map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), blocks, _BLOCK)
    index.write.partitionBy("lead").parquet(folder)
    names = [x.split()[0] for x in _BLOCK.split(", ")]
    return spark.read.schema(_BLOCK).parquet(folder).select(*names)


def _items(queries: DataFrame, key: str) -> DataFrame:
    """Queries as distinct terms with their number of repeats, numbered."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [Counter(terms_of(text)) for text in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "terms": [list(c) for c in found], "repeats": [list(c.values()) for c in found]})

    rows = map_slices(queries.select(F.col(key).cast("long").alias("key"), "text"), counted, "key long, terms array<binary>, repeats array<long>")
    return keep(rows.withColumn("item", F.monotonically_increasing_id()), "search-items")


def placed(asked: pa.Array, own: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which of the asked terms a block has, and their numbers there."""
    at = pc.index_in(asked, value_set=own)
    return np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False)), at.drop_null().to_numpy().astype(np.int64)


def document_counts(index: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """Number of documents that hold each of the terms; at most so many rows come to the driver."""
    asked = pa.array(terms, pa.binary())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, sizes in zip(batch.column("terms"), batch.column("sizes")):
                held, place = placed(asked, own.values)
                total[held] += np.frombuffer(sizes.as_py(), "<i4")[place]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": found, "n": total[found]})

    rows = index.select("terms", "sizes").mapInArrow(counted, "term long, n long")
    return {terms[r["term"]]: r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}


class Postings:
    """Lists of a block for some terms, one after another, with sparse tables of where the largest impact is."""

    def __init__(self, sizes: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int):
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.docs, self.impacts, self.n_docs = docs, impacts, n_docs
        self.keys = np.repeat(np.arange(len(sizes)), sizes) * n_docs + docs
        longest = int(sizes.max()) if len(sizes) else 0
        self.levels = np.zeros(longest + 1, np.int64)
        for n in range(2, longest + 1):
            self.levels[n] = self.levels[n // 2] + 1
        # entry i of level j: place of the largest of the 2 ** j impacts from i on (never asked across the end of a list)
        self.table = [np.arange(len(impacts), dtype=np.int32)]
        for j in range(1, int(self.levels[longest]) + 1):
            low = self.table[-1]
            high = np.concatenate([low[1 << j - 1 :], low[len(low) - (1 << j - 1) :]])
            self.table.append(np.where(impacts[low] >= impacts[high], low, high))
        self.table = np.stack(self.table)

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of the largest impact in each slice; of an empty slice, any place."""
        size = np.maximum(high - low, 1)
        level = self.levels[size]
        left = self.table[level, np.minimum(low, len(self.docs) - 1)]
        right = self.table[level, np.maximum(np.minimum(high, len(self.docs)) - (1 << level), 0)]
        return np.where(self.impacts[left] >= self.impacts[right], left, right)


def search_block(postings: Postings, terms: np.ndarray, repeats: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
    """The k best documents of a block as (score, number), scores of at least `floor` only, best first.

    `terms` are numbers of lists of the block, `repeats` how often the query has each. A cut takes some intervals at once.
    """
    if not len(terms):
        return []
    best: list[tuple[int, int]] = []  # a heap of (score, -number): the worst is first
    heap: list[tuple[int, int, int]] = []
    pool: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def push(low: np.ndarray, high: np.ndarray, first: np.ndarray) -> None:
        """Intervals by the slices of the lists; `first` is the first document of each."""
        at = postings.largest(low, high)
        worth = np.where(high > low, postings.impacts[at] * repeats, 0)
        bound = worth.sum(axis=1)
        top = worth.argmax(axis=1)
        split = postings.docs[at[np.arange(len(at)), top]]
        pool.append((low, high, split, first))
        for i in np.flatnonzero((bound > 0) & (bound >= floor)).tolist():
            heapq.heappush(heap, (-int(bound[i]), int(first[i]), (len(pool) - 1) << 32 | i))

    def hopeless(bound: int, first: int) -> bool:
        return len(best) == k and (bound < best[0][0] or bound == best[0][0] and first >= -best[0][1])

    push(postings.starts[terms][None], postings.starts[terms + 1][None], np.zeros(1, np.int64))
    while heap:
        taken = []
        while heap and len(taken) < AT_A_TIME:
            bound, first, place = heapq.heappop(heap)
            if hopeless(-bound, first):
                heap = []
                break
            taken.append(place)
        if not taken:
            break
        low, high, split, first = (np.stack([pool[p >> 32][x][p & 0xFFFFFFFF] for p in taken]) for x in range(4))
        at = np.searchsorted(postings.keys, terms * postings.n_docs + split[:, None])
        held = (at < high) & (postings.docs[np.minimum(at, len(postings.docs) - 1)] == split[:, None])
        score = np.where(held, postings.impacts[np.minimum(at, len(postings.docs) - 1)] * repeats, 0).sum(axis=1)
        for s, d in zip(score.tolist(), split.tolist()):
            if s >= floor and s > 0:
                if len(best) < k:
                    heapq.heappush(best, (s, -d))
                elif (s, -d) > best[0]:
                    heapq.heapreplace(best, (s, -d))
        push(np.concatenate([low, at + held]), np.concatenate([at, high]), np.concatenate([first, split + 1]))
    return [(s, -d) for s, d in sorted(best, reverse=True)]


def _search(index: DataFrame, items: list, weights: dict[bytes, int], totals: tuple[int, int], k: int, floors: dict[int, int]) -> DataFrame:
    """Up to k documents of every block for each of the items: item, key, doc_id, score."""
    n_all, l_all = totals
    terms = sorted({t for item in items for t in item["terms"] if t in weights})
    number = {t: i for i, t in enumerate(terms)}
    worth = np.array([weights[t] for t in terms], np.int64)
    asked = []
    for item in items:
        pairs = sorted((number[t], n) for t, n in zip(item["terms"], item["repeats"]) if t in number)
        asked.append((item["item"], item["key"], np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, floor = pa.array(terms, pa.binary()), dict(floors)
        for batch in batches:
            for at in range(batch.num_rows):
                rows = one_block({name: batch.column(name)[at] for name in batch.schema.names}, names, floor)
                columns = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _FOUND)

    def one_block(block: dict, names: pa.Array, floor: dict) -> list[tuple]:
        read = lambda name, kind: np.frombuffer(block[name].as_py(), kind).astype(np.int64)
        held, own = placed(names, block["terms"].values)
        sizes, ids = read("sizes", "<i4"), read("doc_ids", "<i8")
        mine, begins = sizes[own], (np.cumsum(sizes) - sizes)[own]
        spot = np.repeat(begins - (np.cumsum(mine) - mine), mine) + np.arange(mine.sum())
        if not len(spot):
            return []
        docs, counts = read("docs", "<i4")[spot], read("counts", "<i4")[spot]
        size = 100 - 25 + 25 * read("lengths", "<i8") * n_all // l_all
        impacts = np.repeat(worth[held], mine) * (1_000_000_000 * counts // (1000 * counts + 12 * size[docs]))
        postings = Postings(mine, docs, impacts, len(ids))
        local = np.full(len(terms), -1, np.int64)
        local[held] = np.arange(len(held))
        rows = []
        for item, key, numbers, repeats in asked:
            here = local[numbers]
            found = search_block(postings, here[here >= 0], repeats[here >= 0], k, floor.get(item, 0))
            rows += [(item, key, None if ids[d] == LAST else int(ids[d]), s) for s, d in found]
            if len(found) == k:
                floor[item] = max(floor.get(item, 0), found[-1][0])
        return rows

    return index.mapInArrow(searched, "item long, key long, doc_id long, score long")


def rank(docs: DataFrame, queries: DataFrame, key: str, k: int, documents: int = DOCUMENTS) -> DataFrame:
    """The k best documents of each query row (key, text): key, rank, doc_id, score."""
    index = build_index(docs, documents)
    items = _items(queries, key)
    sums = index.agg(F.coalesce(F.sum("filled"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    totals, n_terms = (sums[0], sums[1]), items.agg(F.sum(F.size("terms"))).first()[0] or 0
    batches, found = max(1, -(-n_terms // BATCH_TERMS)), []
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    best = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    for batch in range(batches):
        asked = items.filter(F.pmod(F.xxhash64("item"), F.lit(batches)) == batch).collect()
        n_docs = document_counts(index, sorted({t for item in asked for t in item["terms"]}))
        weights = {t: math.floor(1000 * math.log((2 * totals[0] + 2) / (2 * n + 1))) for t, n in n_docs.items()}
        first = keep(_search(index.filter("lead"), asked, weights, totals, k, {}), "search-lead")
        floors = {r["item"]: r["score"] for r in first.withColumn("rank", best).filter(F.col("rank") == k).collect()}
        found.append(first.unionByName(_search(index.filter("not lead"), asked, weights, totals, k, floors)))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", best.cast("int")).filter(F.col("rank") <= k)
    return ranked.select(F.col("key").alias(key), "rank", "doc_id", "score")
