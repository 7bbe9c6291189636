"""Document fingerprints from chains of content words that follow common words.

The commonest short words of the whole corpus are the anchors. The content words that follow an anchor, up to
`chain` of them and up to the next anchor, are a signature, hashed to 32 bits; so is the chain that begins a text,
and the whole of a text of nothing but anchors.
A fingerprint is the set of a text's signatures, written as eight hexadecimal digits each, in ascending order.
Signs, capitals and line breaks don't count, so a fingerprint stays while a text is reformatted, and changes only
around the words that are edited.

Likeness is the Jaccard similarity of two sets. It cannot exceed the ratio of their sizes, so sets are compared
only with sets of their own length partition and the next, and, within, only where they share one of the rarest
signatures that two like sets must share.

Everything is DataFrame operations on the JVM.

Null texts are empty ones; an empty text, or one without letters and digits, has the empty fingerprint, and two
empty fingerprints have likeness 1. Rows with equal doc_id are ordered by their texts; a null doc_id comes last.
Of other columns none is read. An empty table gives an empty result; a single document follows itself.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from burdenflow.llm.store import width
from burdenflow.operators.joins import natural_join

ANCHORS, LONGEST, CHAIN = 24, 5, 3
_SIGNS = r"[^\p{L}\p{N}]+"


def anchors_of(docs: DataFrame, most: int = ANCHORS, longest: int = LONGEST) -> list[str]:
    """The commonest words of at most `longest` letters over all texts; at most `most` of them come to the driver."""
    words = docs.select(F.explode(F.split(F.lower("text"), _SIGNS)).alias("word"))
    words = words.filter(F.col("word").rlike(rf"^\p{{L}}{{1,{longest}}}$"))
    common = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return [r["word"] for r in common.collect()]


def signatures(text: Column, anchors: Sequence[str], chain: int = CHAIN) -> Column:
    """Sorted distinct signatures of a text."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), _SIGNS, " "), F.lit(" "))
    # each anchor is a cut of its own, with nothing between those of a run: a repeated group would go as deep as the run
    parts = F.split(plain, rf" (?:{'|'.join(anchors)})(?= )") if anchors else F.array(plain)
    chains = F.transform(parts, lambda p: F.substring_index(F.trim(p), " ", chain))
    kept = F.filter(chains, lambda c: c != "")
    # a text of nothing but anchors is its own chain
    kept = F.when((F.size(kept) == 0) & (F.trim(plain) != ""), F.array(F.trim(plain))).otherwise(kept)
    hashed = F.transform(kept, lambda c: F.lpad(F.hex(F.xxhash64(c).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.array_sort(F.array_distinct(hashed))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 where their sizes alone keep it below `least`."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    value = shared / (F.size(a) + F.size(b) - shared).cast("double")
    return F.when(large == 0, 1.0).when(small < large * least, 0.0).otherwise(value)


def followed(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text, the text of the next document in descending order of doc_id; the first follows the last.

    Ranges of doc_id between approximate quantiles (`part`) are ordered each on its own; each also gets the first
    document of the next range, marked as `extra`.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = width(spark)
    cuts = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    lower = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<bigint>")
    ranges = F.coalesce(F.size(F.filter(lower, lambda c: c <= F.col("doc_id"))), F.lit(-1))
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), -1).otherwise(ranges))
    tops = sorted(((r["part"], r["top"]) for r in rows.groupBy("part").agg(F.max("doc_id").alias("top")).collect()), reverse=True)
    if not tops:
        return rows.withColumns({"extra": F.lit(False), "next_text": F.lit(None).cast("string")})
    after = [(part, tops[(i + 1) % len(tops)]) for i, (part, _) in enumerate(tops)]
    pairs = F.explode(F.array(*[F.struct(F.lit(part).alias("before"), F.lit(at).alias("part"), F.lit(top).cast("long").alias("doc_id")) for part, (at, top) in after]))
    heads = spark.range(1).select(pairs.alias("p")).select("p.*")
    first = natural_join(rows, heads, "inner", on=["part", "doc_id"]).groupBy("before", "doc_id").agg(F.min("text").alias("text"))
    extra = first.select("doc_id", "text", F.col("before").alias("part"), F.lit(True).alias("extra"))
    both = rows.withColumn("extra", F.lit(False)).unionByName(extra)
    return both.withColumn("next_text", F.lead("text").over(in_order()))


def in_order() -> WindowSpec:
    return Window.partitionBy("part").orderBy("extra", F.col("doc_id").desc_nulls_last(), "text")


def fingerprints(docs: DataFrame, anchors: Sequence[str] | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited form, whose last third comes from the next text, with likenesses."""
    anchors = anchors_of(docs) if anchors is None else anchors
    rows = followed(docs)
    size = F.char_length("text")
    third = F.floor(size / 3).cast("int")
    rows = rows.withColumn("n_chars", size.cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), size - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    )
    rows = rows.select(
        "doc_id", "part", "extra", "text", "n_chars",
        F.when(~F.col("extra"), F.sha2(F.col("edited"), 256)).alias("edited_sha256"),
        signatures(F.col("text"), anchors).alias("own"),
        F.when(~F.col("extra"), signatures(F.col("edited"), anchors)).alias("changed"),
    )
    rows = rows.withColumn("following", F.lead("own").over(in_order())).filter(~F.col("extra"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.array_join("own", "").alias("fingerprint"),
        F.array_join("changed", "").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )


def near_fingerprints(docs: DataFrame, least: float = 0.8, anchors: Sequence[str] | None = None) -> DataFrame:
    """Pairs of different fingerprints with likeness of `least` or more: a, b (a < b) and likeness.

    Texts of equal fingerprint need no pair; group by fingerprint for them. Empty fingerprints are in no pair.
    """
    anchors = anchors_of(docs) if anchors is None else anchors
    sets = docs.select(signatures(F.coalesce("text", F.lit("")), anchors).alias("set")).filter(F.size("set") > 0).distinct()
    sets = sets.withColumn("id", F.array_join("set", ""))
    rarity = sets.select(F.explode("set").alias("signature")).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    held = sets.select("id", F.size("set").alias("size"), F.explode("set").alias("signature")).join(rarity, "signature")
    place = F.row_number().over(Window.partitionBy("id").orderBy("n", "signature"))
    # two sets of likeness t share one of the first size - ceil(t size) + 1 signatures of either
    first = held.withColumn("place", place).filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * (least - 1e-9)) + 1)
    part = F.floor(F.log(F.col("size").cast("double")) / math.log(1 / least) + 1e-9) if least < 1 else F.col("size").cast("long")
    first = first.select("id", "size", "signature", part.alias("part"))
    left = first.select(F.col("id").alias("a"), F.col("size").alias("size_a"), "signature", "part")
    # a set meets those of its own length partition and of the next longer one
    right = first.select(F.col("id").alias("b"), F.col("size").alias("size_b"), "signature", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"))
    pairs = left.join(right, ["signature", "part"]).filter("a != b and least(size_a, size_b) >= greatest(size_a, size_b) * %r" % (least - 1e-9))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    full = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    compared = pairs.join(full[0], "a").join(full[1], "b").select("a", "b", likeness(F.col("set_a"), F.col("set_b"), least).alias("likeness"))
    return compared.filter(F.col("likeness") >= least)
