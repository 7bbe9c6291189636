"""Text expressions used while cleaning site, period, age and parameter names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PERIOD_WIDTH = 7


def parse_number(c: Column) -> Column:
    """First number in a text, ignoring grouping commas; NULL when there is none."""
    found = F.regexp_extract(c, r"(-?\d[\d,]*(?:\.\d+)?|-?\.\d+)", 1)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def period_of(c: Column) -> Column:
    """Period part of a part name such as ``Site 2006-07``: its last seven characters."""
    return F.right(c, F.lit(PERIOD_WIDTH))


def site_of(c: Column, period: Column) -> Column:
    """Part name without ``' ' + period``; left alone when it does not end that way."""
    suffix = F.concat(F.lit(" "), period)
    keep = F.length(c) - F.length(suffix)
    return F.when(F.endswith(c, suffix), F.substr(c, F.lit(1), keep)).otherwise(c)


def age_of(c: Column) -> Column:
    """Age in whole years from an age-band text; the infant band counts as age 0."""
    return F.when(c == "3m-11m", F.lit(0)).otherwise(parse_number(c).cast("int"))


def parameter_index(c: Column) -> Column:
    """Index inside the brackets of a parameter name (``PR[12]`` gives 12), else NULL."""
    return F.regexp_extract(c, r"\[(\d+)\]", 1).try_cast("int")


def study_id(site: Column, period: Column) -> Column:
    """``site period``; a missing part shows as the text ``NA`` and never drops the key."""
    return F.concat(F.coalesce(site, F.lit("NA")), F.lit(" "), F.coalesce(period, F.lit("NA")))


def split_site(df: DataFrame, column: str = "site") -> DataFrame:
    """Split ``site, country`` in two; extra parts are dropped, a missing part is NULL."""
    parts = F.split(F.col(column), ",")
    country = F.replace(F.try_element_at(parts, F.lit(2)), F.lit(" "), F.lit(""))
    return df.withColumn("country", country).withColumn(column, F.try_element_at(parts, F.lit(1)))
