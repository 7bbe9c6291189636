"""Choosing, renaming, recoding, stacking and filtering columns and rows."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def select_renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Keep the named columns under new names: old name to new name."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


def matching(columns: Sequence[str], include: str, exclude: str | None = None) -> list[str]:
    return [c for c in columns if re.search(include, c) and not (exclude and re.search(exclude, c))]


def select_matching(df: DataFrame, include: str, exclude: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Columns whose name matches a pattern, besides those always kept."""
    chosen = [c for c in matching(df.columns, include, exclude) if c not in keep]
    return df.select(*[F.col(f"`{c}`") for c in [*keep, *chosen]])


def rename_matching(df: DataFrame, pattern: str, repl: str = "") -> DataFrame:
    return df.toDF(*[re.sub(pattern, repl, c) for c in df.columns])


def recode(df: DataFrame, column: str, mapping: Mapping[str, str], keep_others: bool = True) -> DataFrame:
    """Replace values through a small fixed mapping; other values stay, or become NULL."""
    old = F.col(column)
    pairs = [F.lit(v) for pair in mapping.items() for v in pair]
    new = F.try_element_at(F.create_map(*pairs), old)
    return df.withColumn(column, F.coalesce(new, old) if keep_others else new)


def to_long(df: DataFrame, id_cols: Sequence[str], name: str = "parameter", value: str = "value") -> DataFrame:
    """One row per column that is not an id."""
    values = [F.col(f"`{c}`") for c in df.columns if c not in id_cols]
    return df.unpivot([F.col(f"`{c}`") for c in id_cols], values, name, value)


def append(*dfs: DataFrame) -> DataFrame:
    """Stack tables by column name; a column one table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def drop_all_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows where none of the columns has a value."""
    return df.dropna(how="all", subset=list(columns))


def filter_parameter(df: DataFrame, include: str, exclude: str | None = None, column: str = "parameter") -> DataFrame:
    kept = df.where(F.col(column).rlike(include))
    return kept.where(~F.col(column).rlike(exclude)) if exclude else kept


def single(df: DataFrame, value: Column) -> Column:
    """An aggregate over a whole table, worked out once, as a constant that any other table can use."""
    row = df.agg(value.alias("value"))
    return F.lit(row.first()["value"]).cast(row.schema["value"].dataType)


def above_threshold(df: DataFrame, column: str, scalar: Column, factor: float = 1.0) -> DataFrame:
    return df.where(F.col(column) >= scalar * factor)


def grid(df: DataFrame, n: int, name: str) -> DataFrame:
    """Repeat every row for the steps 0..n-1 of a grid; the step is the integer column ``name``."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))


def step_value(index: Column, step: float | None = None, per: int | None = None, start: float = 0.0) -> Column:
    """Grid value of an integer step, by step width or by steps per unit; steps never accumulate."""
    moved = index.cast("double") / per if per else index * F.lit(step)
    return moved + start if start else moved
