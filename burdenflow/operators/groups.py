"""Counts, sums and totals per group.

All of them are plain aggregations, so Spark combines rows before the shuffle and a group
that holds much of the table costs no task more than its share. Totals that belong on every
row are aggregated and joined back for the same reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from burdenflow.functions import clinical as c
from burdenflow.operators.joins import natural_join
from burdenflow.operators.ordering import prefix_sums
from burdenflow.operators.shaping import drop_all_null


def null_sum(value: Column) -> Column:
    """Sum that is NULL as soon as one value is."""
    return F.when(F.count_if(value.isNull()) == 0, F.sum(value))


def null_sum_distinct(value: Column) -> Column:
    """Sum of the distinct values, NULL as soon as one value is.

    Equal values count once, also where they come from different sites.
    """
    return F.when(F.count_if(value.isNull()) == 0, F.sum_distinct(value))


def flag_sum(flag: Column) -> Column:
    """Number of true flags; unknown flags count as 0, also where all are unknown."""
    return F.coalesce(F.sum(flag.cast("int")), F.lit(0)).cast("long")


def group_total(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the null-propagating sum of a column over the group to each of its rows."""
    totals = df.groupBy(*keys).agg(null_sum(F.col(value)).alias(name))
    return natural_join(df, totals, "left", on=keys)


def next_value(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Add the value of the following row of the group, for groups small by nature such as ages."""
    following = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.lead(value).over(following))


def group_mean_ratio(df: DataFrame, keys: Sequence[str], num: str, den: str, name: str = "pr") -> DataFrame:
    """Add the mean of num / den over the group to each of its rows."""
    means = df.groupBy(*keys).agg(F.avg(c.ratio(F.col(num), F.col(den))).alias(name))
    return natural_join(df, means, "left", on=keys)


def delta_from_best(df: DataFrame, keys: Sequence[str], score: str, name: str = "delta") -> DataFrame:
    """Add the distance of a score from the lowest of its group, which are the few models compared."""
    return df.withColumn(name, F.col(score) - F.min(score).over(Window.partitionBy(*keys)))


def case_counts(df: DataFrame, flag: str, population: DataFrame, keys: Sequence[str] = ("study_id",)) -> DataFrame:
    """Cases, person-years and rate per 1,000 for every group in df; the keys are never missing."""
    counted = df.groupBy(*keys).agg(flag_sum(F.col(flag)).alias("n"))
    joined = natural_join(counted, population, "left", on=keys, null_safe=False)
    return joined.withColumn("rate", c.rate(F.col("n"), F.col("py")))


def class_counts(df: DataFrame, status: str, cls: str, keys: Sequence[str] = ("study_id",)) -> DataFrame:
    """Positives and patients of known status per group and evidence class."""
    known = df.where(F.col(status).isNotNull())
    return known.groupBy(*keys, cls).agg(
        F.sum(F.col(status).cast("int")).alias("n_positives"), F.count(F.lit(1)).alias("n_patients")
    )


def unknown_counts(
    df: DataFrame, status: str, cls: str, classes: Sequence[int], keys: Sequence[str] = ("study_id",)
) -> DataFrame:
    """Patients of unknown status per group, one column per class.

    The classes are counted side by side, so a group without unknown patients has zeros and
    no join is needed to bring it back.
    """
    unknown = F.col(status).isNull()
    columns = [F.count_if(unknown & (F.col(cls) == k)).alias(f"class_{k}") for k in classes]
    return df.groupBy(*keys).agg(*columns)


def row_ranges(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First and last row number of each group if the table were sorted by the keys.

    Running totals of the group sizes give them without sorting the rows.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    summed = prefix_sums(sizes, keys, "_rows", name="_before")
    return summed.select(
        *keys, (F.col("_before") + 1).alias("min_index"), (F.col("_before") + F.col("_rows")).alias("max_index")
    )


def known_evidence(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return drop_all_null(df, columns)


def constancy(df: DataFrame, keys: Sequence[str], value: str, rule: str) -> DataFrame:
    """Groups in which a value that should be the same on every row is not, with the values' number and ends.

    Columns ``rule``, ``key`` (the keys as text), ``n_rows``, ``n_values``, ``low`` and ``high`` (as text). A missing
    value beside a known one counts as a value. Equal values are counted first, so a key with many rows is a few.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    text = F.col(value).cast("string")
    found = counted.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_values"), F.min(text).alias("low"), F.max(text).alias("high")
    )
    key = F.concat_ws(" ", *[F.coalesce(F.col(k).cast("string"), F.lit("NA")) for k in keys])
    return found.where("n_values > 1").select(F.lit(rule).alias("rule"), key.alias("key"), "n_rows", "n_values", "low", "high")
