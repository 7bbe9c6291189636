"""Near copies by ProbMinHash over word shingles, banding and exact verification.

A text is a set of shingles, five words each (one shingle of all words for a shorter text), of weight 1 + ln(count).
Every shingle sends points of a Poisson process of rate its weight, drawn from its hash alone, to random registers; a
register keeps the shingle whose point arrives first. A shingle stops as soon as its next point is later than every
register's. Two texts agree in a register with the probability Jaccard similarity of their weighted shingles.
Registers are cut into bands; texts that agree in a band share a bucket. Repeated lines in one of two texts part
their weighted shingles, though the sets stay alike; so a text in which a shingle repeats also has the bands of weight
1 for each, where the probability is the Jaccard similarity of the sets. Without repeats both bands are the same.

Two texts are linked if the exact probability Jaccard similarity of their weighted shingles, or the exact Jaccard
similarity of their shingle sets, is 0.8 or more.

Equal texts are one text throughout. In a bucket every text is compared with a leader, the text with most company
in all its buckets. What remains are texts not linked to the leader. Both distances (1 - similarity) are metrics, so
such a text can be linked only to those whose distance from the leader differs by no more than the bound in one of
them; these are compared in tiles of bounded size, as matrix products, which give the links without listing pairs.
The products also bound the weighted similarity, by the share of either text's weight that stands in the other; only
pairs that this leaves open, hold a repeat and aren't connected otherwise are formed one by one. So every link between
two texts of a bucket is found, and large groups cost neither pairs nor one large task: a leader's set is dealt out to
as many parts as its bucket has thousands of texts. Classes are the connected components of the links.

With 26 bands of five registers two texts of similarity 0.8, in either sense, share no bucket with a probability of 3
in 100,000.

Words are what stands between white space, lower-cased. Null texts are empty ones; texts without words are near
copies of equal texts only. A null doc_id counts as larger than any other. Repeated rows are copies. Other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burdenflow.llm.components import components
from burdenflow.llm.slices import map_slices
from burdenflow.llm.store import keep

WORDS, BANDS, ROWS, ALIKE, TILE = 5, 26, 5, 0.8, 512
#: Texts of a bucket that share one copy of their leader's set.
SHARE = 4096
_STEP, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Shingles and texts whose points are drawn together.
TOGETHER, TEXTS = 200_000, 512


def mixed(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit number for each 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles in ascending order, and their counts."""
    from xxhash import xxh3_64_intdigest

    found = (text or "").lower().split()
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))
    n = min(words, len(found))
    total = hashed[: len(found) - n + 1].copy()
    for k in range(1, n):
        total = mixed(total * _STEP + hashed[k : len(found) - n + 1 + k])
    return np.unique(total, return_counts=True)


def sketches(texts: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """One row of registers for each text, holding the shingle that arrives first; texts have at least one shingle.

    A shingle's weight is 1 + ln(count)."""
    number = np.repeat(np.arange(len(texts)), [len(h) for h, _ in texts])
    element = np.concatenate([h for h, _ in texts])
    rate = 1 + np.log(np.concatenate([c for _, c in texts]))
    arrival = np.full(len(texts) * registers, np.inf)
    owner = np.zeros(len(texts) * registers, np.uint64)
    latest = np.full(len(texts), np.inf)
    time, turn = np.zeros(len(element)), 0
    while len(element):
        drawn = mixed(element + np.uint64(int(_STEP) * (2 * turn + 1) % 2**64))
        time = time - np.log(((drawn >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / rate
        early = time < latest[number]
        element, number, rate, time, drawn = element[early], number[early], rate[early], time[early], drawn[early]
        place = number * registers + (mixed(drawn + _A) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(arrival, place, time)
        first = arrival[place] == time
        owner[place[first]] = element[first]
        latest = arrival.reshape(len(texts), registers).max(axis=1)
        turn += 1
    return owner.reshape(len(texts), registers)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard similarity of elements a with weights x and elements b with weights y; a and b are sorted.

    A shared element i arrives first in both with probability 1 / sum over j of max(x_j / x_i, y_j / y_i). In the order
    of y / x the elements up to i count there with their x, those after it with their y.
    """
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    ratio = y[j] / x[i]
    order = np.argsort(ratio)
    ratio, mine, other = ratio[order], x[i][order], y[j][order]
    up_to = x.sum() - mine.sum() + np.cumsum(mine)
    after = y.sum() - np.cumsum(other)
    return float((mine / (up_to + after / ratio)).sum())


def band_hashes(rows: np.ndarray, bands: int, size: int) -> np.ndarray:
    """One signed 64-bit number for each band of each text; equal ones only for the same band."""
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (len(rows), bands))
    for k in range(size):
        total = mixed(total * _STEP + rows[:, k : bands * size : size])
    return total.view(np.int64)


def text_key(text: str) -> Column:
    """Sixteen bytes that stand for a text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def buckets(docs: DataFrame, words: int, bands: int, size: int) -> DataFrame:
    """doc_id, key and the band hashes of every row; texts without words have none."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bands_of: list = [[]] * len(batch)
            held, at, total = [], [], 0

            def flush():
                if held:
                    plain = [(h, np.ones_like(c)) for h, c in held]
                    for i, row in zip(at, band_hashes(sketches(plain, bands * size), bands, size)):
                        bands_of[i] = row
                    repeating = [k for k, (_, c) in enumerate(held) if c.max() > 1]
                    if repeating:
                        weighted = sketches([held[k] for k in repeating], bands * size)
                        for k, row in zip(repeating, band_hashes(weighted, bands, size)):
                            bands_of[at[k]] = np.unique(np.concatenate([bands_of[at[k]], row]))
                    held.clear()
                    at.clear()

            for i, text in enumerate(batch["text"]):
                found = shingles(text, words)
                if len(found[0]):
                    held.append(found)
                    at.append(i)
                    total += len(found[0])
                    if total >= TOGETHER or len(held) >= TEXTS:
                        flush()
                        total = 0
            flush()
            yield batch[["doc_id", "key"]].assign(bands=bands_of)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("key"), "text")
    return map_slices(rows, hashed, "doc_id long, key binary, bands array<long>")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """key, the sorted distinct shingle hashes (8 bytes each) and their counts (4 bytes; none if all are 1) of every text."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(t, words) for t in batch["text"]]
            counts = [c.astype(np.uint32).tobytes() if (c > 1).any() else b"" for _, c in found]
            yield pd.DataFrame({"key": batch["key"], "set": [h.tobytes() for h, _ in found], "counts": counts})

    return texts.select("key", "text").mapInPandas(hashed, "key binary, set binary, counts binary")


def unpacked(shingle_set: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their weights."""
    found = np.frombuffer(shingle_set, np.uint64)
    return found, 1 + np.log(np.frombuffer(counts, np.uint32)) if counts else np.ones(len(found))


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b with the similarity of their sets and that of their weighted shingles.

    pairs: a, b and n, the number of texts that are compared with a in one bucket, at most.
    """

    @F.pandas_udf("similarity double, weighted double")
    def similarity(a: pd.Series, b: pd.Series, counts_a: pd.Series, counts_b: pd.Series) -> pd.DataFrame:
        out = []
        for s, t, c, d in zip(a, b, counts_a, counts_b):
            (s, x), (t, y) = unpacked(s, c), unpacked(t, d)
            shared = len(np.intersect1d(s, t, assume_unique=True))
            plain = shared / (len(s) + len(t) - shared)
            same = c == d and (not c or plain == 1)
            out.append((plain, plain if same else probability_jaccard(s, x, t, y)))
        return pd.DataFrame(out, columns=["similarity", "weighted"], dtype=float)

    named = lambda key: sets.select(F.col("key").alias(key), F.col("set").alias(f"set_{key}"), F.col("counts").alias(f"counts_{key}"))
    parts = F.ceil(F.col("n") / SHARE).cast("int")
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    leaders = pairs.groupBy("a").agg(F.max(parts).alias("parts")).join(named("a"), "a")
    leaders = leaders.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = dealt.join(named("b"), "b").join(leaders, ["a", "part"])
    return both.select("a", "b", similarity("set_a", "set_b", "counts_a", "counts_b").alias("found")).select("a", "b", "found.*")


def shared_weight(sets: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """The weight of each text's shingles that stand in each other text, by products of incidences, some shingles at a time."""
    which, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner, weight = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(weights)
    common = np.bincount(place, minlength=len(which)) > 1
    column = np.cumsum(common) - 1
    some = common[place]
    owner, weight, place, shared = owner[some], weight[some], column[place[some]], np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    owner, weight, place = owner[order], weight[order], place[order]
    plain = bool((weight == 1).all())
    for start in range(0, int(common.sum()), 4096):
        a, b = np.searchsorted(place, [start, start + 4096])
        table = np.zeros((len(sets), 4096), np.float32)
        table[owner[a:b], place[a:b] - start] = 1
        weighted = table
        if not plain:
            weighted = np.zeros((len(sets), 4096), np.float32)
            weighted[owner[a:b], place[a:b] - start] = weight[a:b]
        shared += weighted @ table.T
    return shared


def similarities(sets: list[np.ndarray]) -> np.ndarray:
    """Similarity of all pairs of a bounded number of sets."""
    sizes = np.array([len(s) for s in sets], float)
    shared = shared_weight(sets, [np.ones(len(s)) for s in sets])
    return shared / (sizes[:, None] + sizes[None, :] - shared)


def weighted_groups(root: np.ndarray, sets: list[np.ndarray], weights: list[np.ndarray], near: np.ndarray, alike: float) -> np.ndarray:
    """groups_in() after the links of weighted similarity among the pairs marked `near` are added."""
    repeating = np.array([bool((w > 1).any()) for w in weights])
    near = near & (repeating[:, None] | repeating[None, :]) & (root[:, None] != root[None, :])
    if not near.any():
        return root
    # both texts' first arrivals can agree no more often than the weight, of either, that stands in the other
    part = shared_weight(sets, weights) / np.array([w.sum() for w in weights])[:, None]
    near &= np.minimum(part, part.T) >= alike - 1e-4
    root = root.copy()
    for i, j in zip(*np.nonzero(np.triu(near | near.T))):
        if root[i] != root[j] and probability_jaccard(sets[i], weights[i], sets[j], weights[j]) >= alike - 1e-9:
            low, high = sorted((root[i], root[j]))
            root[root == high] = low
    return root


def groups_in(alike: np.ndarray) -> np.ndarray:
    """For each of a bounded number of texts, the first text of its group."""
    root = np.arange(len(alike))
    alike = alike | alike.T | np.eye(len(alike), dtype=bool)
    while True:
        least = np.where(alike, root[None, :], len(root)).min(axis=1)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def links(texts: DataFrame, found: DataFrame, words: int = WORDS, alike: float = ALIKE, tile: int = TILE) -> DataFrame:
    """Pairs a, b of keys that together connect all texts of a bucket that links of similarity `alike` connect.

    texts: key and text, equal texts in any number of rows; found: bucket and key, distinct.
    """
    shared = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = keep(found.join(shared, "bucket"), "near-members")
    company = members.groupBy("key").agg(F.sum("n").alias("company"))
    leader = members.join(company, "key").groupBy("bucket").agg(F.max(F.struct("company", "key"))["key"].alias("leader"))
    led = keep(members.join(leader, "bucket"), "near-led")
    once = texts.groupBy("key").agg(F.first("text").alias("text")).join(company.select("key"), "key", "left_semi")
    sets = keep(shingle_sets(once, words), "near-sets")
    pairs = led.filter("key != leader").groupBy(F.col("leader").alias("a"), F.col("key").alias("b")).agg(F.max("n").alias("n"))
    direct = keep(compared(pairs, sets), "near-direct")

    # distances of every member from its bucket's leader; a bucket needs a second look if two unlinked members, or an
    # unlinked and a linked one, are near enough in one of the distances
    bound = 1 - alike
    near = led.join(direct.withColumnsRenamed({"a": "leader", "b": "key"}), ["leader", "key"], "left")
    far = lambda measure: F.when(F.col("key") == F.col("leader"), 0.0).otherwise(1 - F.col(measure))
    near = near.select("bucket", "key", far("similarity").alias("far"), far("weighted").alias("wide"))
    linked = F.least("far", "wide") <= bound + 1e-9
    rest = near.filter(~linked).groupBy("bucket").agg(F.min("far").alias("first_far"), F.min("wide").alias("first_wide"))
    reached = (F.col("far") >= F.col("first_far") - bound - 1e-9) | (F.col("wide") >= F.col("first_wide") - bound - 1e-9)
    open_ = near.join(rest, "bucket").filter((~linked | reached) & (F.greatest("far", "wide") > 1e-12))
    counted = open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    tiles = F.ceil(F.col("members") / tile).cast("int")
    open_ = open_.join(counted, "bucket").select("bucket", "key", "far", "wide", tiles.alias("tiles"))
    open_ = open_.withColumn("tile", F.pmod(F.xxhash64("key", "bucket"), F.col("tiles")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    open_ = open_.select("bucket", "key", "far", "wide", "tile", others)
    low, high = F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")
    open_ = open_.select("bucket", "key", "far", "wide", low, high).join(sets, "key")

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key").reset_index(drop=True)
        far, wide = group["far"].to_numpy(), group["wide"].to_numpy()
        led = np.minimum(far, wide) <= bound + 1e-9
        together = led[:, None] & led[None, :]
        gap, wide_gap = (np.abs(d[:, None] - d[None, :]) <= bound + 1e-9 for d in (far, wide))
        sets, weights = zip(*map(unpacked, group["set"], group["counts"]))
        root = groups_in(together | (gap & (similarities(sets) >= alike - 1e-6)))
        root = weighted_groups(root, sets, weights, wide_gap, alike)
        moved = np.flatnonzero((root != np.arange(len(root))) & ~together[np.arange(len(root)), root])
        return pd.DataFrame({"a": group["key"].to_numpy()[root[moved]], "b": group["key"].to_numpy()[moved]})

    tiled = open_.groupBy("bucket", "low", "high").applyInPandas(joined, "a binary, b binary")
    return direct.filter(F.greatest("similarity", "weighted") >= alike - 1e-9).select("a", "b").union(tiled)


def classes(docs: DataFrame, words: int = WORDS, alike: float = ALIKE, bands: int = BANDS, size: int = ROWS, tile: int = TILE) -> DataFrame:
    """One row for each distinct text: key, first_id (its smallest doc_id), copies, class_key and class_id.

    class_key is one of the class's keys: that of the text with the smallest first_id, class_id.
    """
    rows = keep(buckets(docs, words, bands, size), "near-bands")
    distinct = keep(rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "near-texts")
    found = distinct.select("key", F.explode("bands").alias("bucket"))
    texts = docs.select(text_key("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    roots = components(links(texts, found, words, alike, tile))
    named = distinct.drop("bands").join(roots.withColumnRenamed("node", "key"), "key", "left")
    named = named.withColumn("root", F.coalesce("root", "key"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "key")).alias("first"))
    return named.join(first, "root").select("key", "first_id", "copies", F.col("first.key").alias("class_key"), F.col("first.first_id").alias("class_id"))


def class_members(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its near copies), class_key and copies (rows of the same text) for every row."""
    found = classes(docs, **options).select("key", "class_key", "class_id", "copies")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("key"))
    return rows.join(found, "key").select("doc_id", "class_id", F.lower(F.hex("class_key")).alias("class_key"), "copies")


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each class: of the text with the smallest doc_id, the row with that doc_id."""
    chosen = classes(docs, **options).filter("key = class_key").select(F.col("key").alias("_key"))
    by = F.struct(F.col("doc_id").isNull(), "doc_id", *[F.col(c).cast("string") for c in ("source", "lang") if c in docs.columns])
    once = docs.groupBy(text_key("text").alias("_key")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), by).alias("_row"))
    return once.join(chosen, "_key", "left_semi").select("_row.*")
