"""Positions, exact quantiles and densest intervals of groups of any size.

A sort within a group would put the whole group into one task. Quantiles are bounded by a sketch of each group
and then selected between the bounds. For positions, sums and densest intervals groups are cut into
buckets that follow the order of their values: by their logarithm first, so that buckets are
of one relative width at every magnitude, and each of those into equal steps between its own
smallest and largest value. Buckets are a function of the values, so every evaluation cuts
alike, also after a lost executor. Rows per bucket are counted with partial aggregation, and
only then are rows ordered, bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from burdenflow.operators.joins import natural_join
from burdenflow.operators.shaping import single
from burdenflow.sources.tables import kept

STEPS = 32
FINE = 256
RANK_BLOCK = 100_000
#: Size of a group's sketch; distance of bounds from a rank, as a share of the rows; rows of a group bounded by its ends.
SKETCH, SLACK, SMALL = 800, 0.014, 1000
#: Rows of bounds (one for each group, of some hundred bytes) up to which every task gets all of them.
BROADCAST_GROUPS = 100_000
STRING_HEAD = 8


def coarse(key: Column) -> Column:
    """Number that rises with a numeric key, one for each 1/STEPS of a factor e."""
    x = key.cast("double")
    size = F.abs(x)
    level = F.when(size == float("inf"), F.lit(10**6)).otherwise(F.floor(F.log(size) * STEPS) + 10**5)
    return F.when(F.isnan(x), F.lit(10**7)).when(x == 0, F.lit(0)).when(x < 0, -level).otherwise(level).cast("long")


def with_beginnings(df: DataFrame, by: Sequence[str], key: str, most: int | None = None) -> DataFrame:
    """Add ``_coarse``, the beginning of a string key, which is longer where many rows share one.

    Beginnings of STRING_HEAD letters are counted. Those of more than ``most`` rows are cut again after as many
    letters more, and so on, as a trie grows where it is heavy; only they are counted again. A beginning that isn't cut
    holds all keys that begin with it, so beginnings rise with the keys. One key on many rows stays together.
    """
    most = most or RANK_BLOCK
    placed, depth = df.withColumn("_coarse", F.substring(key, 1, STRING_HEAD)), STRING_HEAD
    while True:
        longer = placed.where((F.length("_coarse") == depth) & (F.length(key) > depth))
        heavy = longer.groupBy(*by, "_coarse").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most)
        heavy = kept(heavy.select(*by, "_coarse", F.lit(True).alias("_heavy")), "heavy-beginnings")
        if heavy.isEmpty():
            return placed
        marked = natural_join(placed, heavy, "left", on=[*by, "_coarse"])
        depth += STRING_HEAD
        deeper = F.when(F.col("_heavy"), F.substring(key, 1, depth)).otherwise(F.col("_coarse"))
        placed = marked.withColumn("_coarse", deeper).drop("_heavy")


def fine(key: Column, low: Column, high: Column) -> Column:
    """Equal steps between the ends of a coarse bucket."""
    x, low, high = key.cast("double"), low.cast("double"), high.cast("double")
    inside = (high > low) & (high < float("inf")) & (low > float("-inf"))
    return F.when(inside, F.floor((x - low) / (high - low) * FINE)).otherwise(F.lit(0)).cast("long")


def with_buckets(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Add ``_coarse`` and ``_fine``, which together rise with the key within its group."""
    if dict(df.dtypes)[key] == "string":
        return with_beginnings(df, by, key).withColumn("_fine", F.lit(0).cast("long"))
    keyed = df.withColumn("_coarse", coarse(F.col(key)))
    ends = keyed.groupBy(*by, "_coarse").agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    placed = natural_join(keyed, ends, "inner", on=[*by, "_coarse"])
    return placed.withColumn("_fine", fine(F.col(key), F.col("_low"), F.col("_high"))).drop("_low", "_high")


def _ranked(df: DataFrame, order: Sequence[str], amount: Column, by: Sequence[str]) -> DataFrame:
    """Add ``_before``, the sum of the amount over earlier rows, and ``_total``, that of the group."""
    placed = with_buckets(df, by, order[0])
    totals = placed.groupBy(*by, "_coarse", "_fine").agg(F.sum(amount).alias("_weight"))
    earlier = Window.partitionBy(*by).orderBy("_coarse", "_fine").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        *by, "_coarse", "_fine", F.coalesce(F.sum("_weight").over(earlier), F.lit(0)).alias("_base"),
        F.sum("_weight").over(Window.partitionBy(*by)).alias("_total"),
    )
    joined = natural_join(placed, bases, "inner", on=[*by, "_coarse", "_fine"])
    inside = Window.partitionBy(*by, "_coarse", "_fine").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("_base") + F.sum(amount).over(inside) - amount
    return joined.withColumn("_before", before).drop("_coarse", "_fine", "_base")


def prefix_sums(
    df: DataFrame, order: Sequence[str], weight: str | None = None, by: Sequence[str] = (), name: str = "before"
) -> DataFrame:
    """Add the sum of ``weight`` (default: rows) over the rows that come earlier in the order.

    ``order`` must be unique within ``by``.
    """
    amount = F.col(weight) if weight else F.lit(1).cast("long")
    return _ranked(df, order, amount, by).drop("_total").withColumnRenamed("_before", name)


def number_rows(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "rn") -> DataFrame:
    """Row number from 1 in a unique order; over distinct values this is their dense rank."""
    return prefix_sums(df, order, by=by, name=name).withColumn(name, F.col(name) + 1)


def _interpolated(probs: Mapping[str, float], pick) -> list[Column]:
    """Linear interpolation between the two order statistics around (n - 1) * p."""
    out = []
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(p)
        low, high = pick(F.floor(at)), pick(F.ceil(at))
        out.append(F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at))).alias(name))
    return out


def _ranks(probs: Mapping[str, float]) -> list[Column]:
    at = [(F.col("_n") - 1) * F.lit(p) for p in probs.values()]
    return [f(a) for a in at for f in (F.floor, F.ceil)]


def rank_bounds(values: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """First reading: rows of each group, and for each probability two values between which its rank lies.

    Each group has one mergeable sketch, whose error in rank is independent of the group's size. The bounds stand
    SLACK away from the wanted rank, ten standard deviations of that error; small groups, and those with NaN (which
    a sketch leaves out), are bounded by their ends.
    """
    x = F.col(value).cast("double")
    real = F.when(~F.isnan(x), x)
    groups = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count(real).alias("_real"), F.kll_sketch_agg_double(real, F.lit(SKETCH)).alias("_sketch")
    )
    ranks = sorted({0.0, 1.0, *(min(1.0, max(0.0, p + d)) for p in probs.values() for d in (-SLACK, SLACK))})
    found = F.when(F.col("_real") > 0, F.kll_sketch_get_quantile_double("_sketch", F.array(*map(F.lit, ranks))))
    whole = (F.col("_real") < F.col("_n")) | (F.col("_n") <= SMALL)
    at = lambda rank, end: F.when(whole, F.get("_found", ranks.index(end))).otherwise(F.get("_found", ranks.index(rank)))
    ends = []
    for i, p in enumerate(probs.values()):
        ends += [at(max(0.0, p - SLACK), 0.0).alias(f"_low{i}"), at(min(1.0, p + SLACK), 1.0).alias(f"_high{i}")]
    return groups.withColumn("_found", found).select(*keys, "_n", *ends)


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group: columns ``by``, ``n`` and one per probability.

    The values are read twice. The first reading bounds the wanted ranks (rank_bounds), one small row for each group,
    kept as a table, so Spark knows its size when it joins. In the second reading values outside all bounds are only
    counted, with partial aggregation, by the bounds that they lie between; equal values are one row. What lies
    between bounds is cut into steps of equal width, and only steps that hold a wanted rank are ordered, each by
    itself, so no task holds a group. A rank outside its bounds ends the query.
    """
    # false everywhere, but no constant: a join keeps it as a key where all others are literals or there are none
    same = (F.xxhash64(value) > F.lit(2**63 - 1)).alias("_same")
    values = df.where(F.col(value).isNotNull()).select(*by, value, same)
    keys = [*by, "_same"]
    bounds = kept(rank_bounds(values, keys, value, probs), "rank-bounds")
    # Spark may take the values for the smaller side, as it can't see how far their rows were exploded
    way = "broadcast" if bounds.count() <= BROADCAST_GROUPS else "merge"
    x, number = F.col(value).cast("double"), range(len(probs))
    inside = [(x >= F.col(f"_low{i}")) & (x <= F.col(f"_high{i}")) for i in number]
    wanted = reduce(Column.__or__, inside, F.isnan(x))
    cell = reduce(Column.__add__, [(x >= F.col(f"_low{i}")).cast("int") + (x > F.col(f"_high{i}")).cast("int") for i in number])
    step = reduce(lambda rest, i: F.when(inside[i], fine(x, F.col(f"_low{i}"), F.col(f"_high{i}"))).otherwise(rest), reversed(number), F.lit(0))
    placed = natural_join(values, bounds.hint(way), "inner", on=keys).select(
        *keys, "_n", cell.alias("_cell"), step.cast("long").alias("_fine"), F.when(wanted, F.col(value)).alias("_value")
    )
    place = [*keys, "_n", "_cell", "_fine"]
    counted = placed.groupBy(*place, "_value").agg(F.count(F.lit(1)).alias("_copies"))
    earlier = Window.partitionBy(*keys).orderBy("_cell", "_fine").rowsBetween(Window.unboundedPreceding, 0)
    steps = counted.groupBy(*place).agg(F.sum("_copies").alias("_rows")).withColumn("_end", F.sum("_rows").over(earlier))
    steps = steps.withColumn("_base", F.col("_end") - F.col("_rows"))
    holds = [(rank >= F.col("_base")) & (rank < F.col("_end")) for rank in _ranks(probs)]
    steps = steps.where(reduce(Column.__or__, holds)).select(*place, "_base")
    inner = Window.partitionBy(*place).orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    found = natural_join(counted, steps.hint(way), "inner", on=place)
    found = found.withColumn("_end", F.col("_base") + F.sum("_copies").over(inner)).withColumn("_start", F.col("_end") - F.col("_copies"))
    pick = lambda rank: F.max(F.when((rank >= F.col("_start")) & (rank < F.col("_end")), F.col("_value")))
    picked = found.groupBy(*keys, "_n").agg(*_interpolated(probs, pick))
    lost = F.raise_error(F.lit("a rank lies outside the bounds that its sketch gave")).cast("double")
    return picked.select(*by, F.col("_n").alias("n"), *[F.coalesce(F.col(name).cast("double"), lost).alias(name) for name in probs])


def hdi(df: DataFrame, by: Sequence[str], value: str, mass: float = 0.95, block: int = RANK_BLOCK) -> DataFrame:
    """Narrowest interval that holds ``floor(n * mass) + 1`` sorted values, the first on ties.

    Columns ``by``, ``n``, ``lower``, ``upper``; no bounds where a group is too small for one.

    Only the first of equal values can open the narrowest interval, so equal values are one
    row with a span of ranks. Spans are cut at blocks of ranks; within a block, the value at
    an interval's closing rank is the last one whose span has begun.
    """
    values = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_copies"))
    ranked = _ranked(values, [value], F.col("_copies"), by)
    spans = ranked.withColumnsRenamed({"_before": "_start", "_total": "n"})
    k = F.floor(F.col("n") * F.lit(mass))
    blocks = lambda lo, hi: F.explode(F.sequence(F.floor(lo / block), F.floor(hi / block)))
    begins = spans.select(
        *by, "n", F.col("_start").alias("_rank"), F.col(value).alias("_begin"), F.lit(None).cast("double").alias("_open"),
        blocks(F.col("_start"), F.col("_start") + F.col("_copies") - 1).alias("_block"),
    )
    closes = spans.where((F.col("_start") + k < F.col("n")) & (F.col("n") >= 2)).select(
        *by, "n", (F.col("_start") + k).alias("_rank"), F.lit(None).cast("double").alias("_begin"),
        F.col(value).alias("_open"), F.floor((F.col("_start") + k) / block).alias("_block"),
    )
    # a value that begins at a rank comes before an interval that closes there
    inside = Window.partitionBy(*by, "_block").orderBy("_rank", F.col("_open").asc_nulls_first())
    at_close = F.last("_begin", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    pairs = begins.unionByName(closes).withColumn("_close", at_close)
    width = F.struct(F.col("_close") - F.col("_open"), F.col("_open"))
    best = F.min_by(
        F.struct(F.col("_open").alias("lower"), F.col("_close").alias("upper")),
        F.when(F.col("_open").isNotNull(), width),
    )
    return pairs.groupBy(*by, "n").agg(best.alias("_best")).select(*by, "n", "_best.lower", "_best.upper")


def order_by_statistic(df: DataFrame, key: Sequence[str], statistic: str, name: str = "position") -> DataFrame:
    """Number the keys by a statistic, ties by key; one row per key comes in."""
    return number_rows(df, [statistic, *key], name=name)


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 7) -> DataFrame:
    """n rows without replacement, the same ones on every run.

    Rows are ordered by a digest of seed and key. The leading digits of the digest are
    counted first, so that about n rows, not the whole table, reach the final ordering.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    marked = df.withColumn("_digest", digest).withColumn("_head", F.substring("_digest", 1, 4))
    heads = marked.groupBy("_head").agg(F.count(F.lit(1)).alias("_rows"))
    upto = F.sum("_rows").over(Window.partitionBy().orderBy("_head"))
    enough = single(heads.withColumn("_upto", upto).where(F.col("_upto") >= n), F.min("_head"))
    near = marked.where((F.col("_head") <= enough) | enough.isNull())
    return near.orderBy("_digest").limit(n).drop("_digest", "_head")


def spread(df: DataFrame) -> DataFrame:
    """Deal narrow rows out over all cores before each of them is expanded into many.

    A table of at least as many files as there are cores is spread already.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df if len(df.inputFiles()) >= parts else df.repartition(parts)
