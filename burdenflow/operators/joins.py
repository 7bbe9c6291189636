"""Joins whose keys may be missing, and key lookups.

No side is forced to be broadcast: Spark does it when the measured size of a side allows,
and splits skewed keys of the other joins at run time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def natural_join(
    left: DataFrame,
    right: DataFrame,
    how: str = "left",
    on: Sequence[str] | None = None,
    null_safe: bool = True,
) -> DataFrame:
    """Join on the columns both sides have, or on those named; a missing key matches a missing key.

    Key columns come out once; in a full join they are taken from whichever side has the row.
    Keys that are never missing, as study keys, are joined plainly (``null_safe=False``): an
    aggregation on the same key then needs no second shuffle.
    """
    keys = list(on) if on is not None else [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("natural join: the tables have no column in common")
    clash = set(left.columns) & set(right.columns) - set(keys)
    if clash:
        raise ValueError(f"natural join: columns on both sides but not keys: {sorted(clash)}")
    if not null_safe:
        return left.join(right, keys, how)
    l, r = left.alias("l"), right.alias("r")
    same = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys]
    joined = l.join(r, reduce(Column.__and__, same), how)
    if how in ("left_semi", "left_anti"):
        return joined
    key = lambda k: (
        F.coalesce(F.col(f"l.`{k}`"), F.col(f"r.`{k}`")) if how in ("full", "right") else F.col(f"l.`{k}`")
    )
    return joined.select(
        *[key(c).alias(c) if c in keys else F.col(f"l.`{c}`") for c in left.columns],
        *[F.col(f"r.`{c}`") for c in right.columns if c not in keys],
    )


def lookup(df: DataFrame, dim: DataFrame, on: dict[str, str]) -> DataFrame:
    """Left join to a table keyed under other names: ``on`` maps a left to a right column."""
    renamed = dim.withColumnsRenamed({right: left for left, right in on.items()})
    return natural_join(df, renamed, "left", on=list(on), null_safe=False)


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of df whose key occurs in keys."""
    return df.join(keys, list(on), "left_semi")


def interval_join(windows: DataFrame, points: DataFrame, low: str, high: str, at: str, width: int) -> DataFrame:
    """Pairs of a window low..high and a point that lies in it, ends included; whole numbers.

    Both are laid on bins of ``width``: a window is repeated for each bin that it meets, a point is in one, and a pair
    meets in the bin of its point. So a window costs as many rows as it meets bins, whatever lies in them.
    """
    bin_of = lambda name: F.floor(F.col(name) / width).cast("long")
    met = windows.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    pairs = met.join(points.withColumn("_bin", bin_of(at)), "_bin")
    return pairs.where(F.col(at).between(F.col(low), F.col(high))).drop("_bin")
