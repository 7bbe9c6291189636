"""Mixing sources to target weights by fitting whole documents to a word budget.

A document's size is its number of words. Each source has a target number of words. All its documents are taken
as many whole times as fit; what remains of the target is fitted by choosing documents to take once more: the
documents of a source are counted by exact size, every size gives its share, and bounded-knapsack dynamic
programming over the counts finds the sizes that use up the last words exactly, or as nearly as can be. Which
documents of a size are taken is decided by a seeded hash of doc_id, so reruns agree.

The counts by size are the only thing gathered by source: a source of n words has at most sqrt(2 n) sizes. Finding
the hash up to which documents of a size are taken goes through a fixed number of hash ranges, so a size that
very many documents share is not sorted in one task.

A null text has size 0, and documents of size 0 are never taken. A null source is a source of its own and comes
last. Repeated rows count and are taken as often as they stand in the table; a null doc_id is hashed like any
other value. Other columns are kept; ones named like a result column are replaced. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burdenflow.llm.store import keep
from burdenflow.operators.joins import natural_join

WORD = r"[^\x20\x09-\x0D]+"
#: Words of which the dynamic programming keeps account (more than this many are first taken as the longest documents), and hash ranges for each size.
LAST_WORDS, RANGES = 1 << 24, 512


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, last_words: int = LAST_WORDS) -> np.ndarray:
    """How many documents of each size to take, so that their words come to the budget or as near below it as found."""
    total = int((sizes * counts).sum())
    if budget <= 0 or total <= 0:
        return np.zeros(len(sizes), np.int64)
    if budget >= total:
        return np.where(sizes > 0, counts, 0).astype(np.int64)
    taken = np.floor(counts * (budget / total)).astype(np.int64) * (sizes > 0)
    left = budget - int((sizes * taken).sum())
    order = [i for i in np.argsort(-sizes, kind="stable") if sizes[i] > 0]
    for i in order:  # longest first, down to what the exact step can handle
        more = min(int(counts[i] - taken[i]), max(0, left - last_words) // int(sizes[i]))
        taken[i] += more
        left -= more * int(sizes[i])
    # bit w of reached: w words can be made up exactly; first[w]: the step that made it so
    reached, steps, mask, first = 1, [], (1 << (left + 1)) - 1, np.zeros(left + 1, np.int32)
    for i in order:
        size, free, lot = int(sizes[i]), min(int(counts[i] - taken[i]), left // int(sizes[i])), 1
        while free and not reached >> left & 1:
            lot = min(lot, free)
            new = (reached << lot * size) & mask & ~reached
            reached |= new
            found = np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8)
            held = np.flatnonzero(found)
            at, bit = np.nonzero(np.unpackbits(found[held, None], axis=1, bitorder="little"))
            first[8 * held[at] + bit] = len(steps)
            steps.append((i, lot))
            free, lot = free - lot, 2 * lot
    at = reached.bit_length() - 1
    while at:
        i, lot = steps[first[at]]
        taken[i] += lot
        at -= lot * int(sizes[i])
    return taken


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size and target of each source: a share of all words by weight, no more than `most` times its size."""
    everything = Window.partitionBy()
    ranked = totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("all", F.sum("source_size").over(everything) * F.lit(float(share)))
    # sources reach their cap in the order of cap / weight; what is left after those is shared by weight
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", (F.col("all") - before) / free)
    full = F.col("cap") <= F.col("level") * F.col("weight")
    level = F.max(F.when(~full, F.col("level"))).over(everything)
    return ranked.select("source", "source_size", F.when(full, F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


MADE = ("size", "source_size", "target", "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents with size, source_size, target (of their source) and copies, the number of times they are taken.

    Columns of the input with these names make room for them.
    """
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in MADE]
    return planned(docs, **options).select(*kept, *MADE)


def planned(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """row (a document with all its columns), size, source_size, target and copies."""
    # rows with one doc_id, or none, differ in their texts, unless they are the same
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    narrow = keep(docs.select("source", words("text").alias("size"), draw.alias("draw")), "mix-sizes")
    counts = narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by_source = source_targets(totals, weights, share, most)

    def chosen(group: pd.DataFrame) -> pd.DataFrame:
        size, n = group["size"].to_numpy(), group["n"].to_numpy()
        total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        every = min(int(target // total), int(most)) if total else 0
        more = fit(size, n, round(target) - every * total) if every < most else 0 * n
        return group.assign(every=every, more=more)

    plan = natural_join(counts, by_source, on=["source"]).groupBy("source").applyInPandas(chosen, "source string, size long, n long, source_size long, target double, every long, more long")
    plan = keep(plan, "mix-plan")

    span = narrow.withColumn("range", F.shiftrightunsigned("draw", 64 - RANGES.bit_length() + 1))
    within = Window.partitionBy("source", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = span.groupBy("source", "size", "range").agg(F.count(F.lit(1)).alias("in_range"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("in_range").over(within), F.lit(0)))
    some = plan.filter("more > 0 and more < n").select("source", "size", "more")
    edge = natural_join(ranges, some, "inner", on=["source", "size"]).withColumn("need", F.col("more") - F.col("before"))
    edge = edge.filter("need > 0 and need <= in_range").select("source", "size", "range", "need")
    inside = natural_join(span, edge, "inner", on=["source", "size", "range"])
    ordered = Window.partitionBy("source", "size", "range").orderBy("draw")
    ties = F.count(F.lit(1)).over(Window.partitionBy("source", "size", "range", "draw"))
    last = inside.select("*", F.row_number().over(ordered).alias("row"), F.rank().over(ordered).alias("rank"), ties.alias("ties"))
    last = last.filter("row = need").select("source", "size", F.col("draw").alias("last_draw"), (F.col("need") - F.col("rank") + 1).alias("tied"), "ties")
    plan = natural_join(plan, last, on=["source", "size"])
    plan = keep(plan.withColumnsRenamed({c: f"_mix_{c}" for c in plan.columns}), "mix-cuts")

    wide = docs.select(F.struct(*docs.columns).alias("row"), "source", words("text").alias("_size"), draw.alias("_draw"))
    wide = wide.join(plan, [F.col("source").eqNullSafe(F.col("_mix_source")), F.col("_size") == F.col("_mix_size")], "left")
    # hashes compare as unsigned numbers, as their ranges do
    flip = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
    more, cut = F.col("_mix_more"), F.col("_mix_last_draw")
    tied = (F.col("_draw") == cut) & (F.col("_mix_tied") < F.col("_mix_ties"))
    extra = F.when(more == 0, False).when(more == F.col("_mix_n"), True)
    if not plan.filter("_mix_tied < _mix_ties").isEmpty():
        # rows with the same doc_id and size stand at the cut, and only some of them are taken
        number = F.row_number().over(Window.partitionBy("source", "_size", "_draw").orderBy("row.doc_id"))
        extra = extra.when(tied, number <= F.col("_mix_tied"))
    extra = extra.otherwise(flip("_draw") <= flip("_mix_last_draw"))
    return wide.select(
        "row",
        F.col("_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        F.when(F.col("_size") == 0, 0).otherwise(F.col("_mix_every") + extra.cast("long")).cast("long").alias("copies"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of the input."""
    taken = planned(docs, **options).filter("copies > 0")
    rows = taken.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
