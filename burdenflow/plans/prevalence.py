"""Prevalence across age ranges and detection methods, in closed form.

The age curve is linear in the underlying prevalence, so the prevalence that explains a
survey is the survey's prevalence divided by the curve's mean over the surveyed ages.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from burdenflow.functions.rates import DETECTION_INTERCEPT, DETECTION_SLOPE
from burdenflow.functions.special import norm_cdf, probit
from burdenflow.operators.groups import group_mean_ratio
from burdenflow.operators.joins import interval_join, natural_join
from burdenflow.operators.ordering import quantiles
from burdenflow.sources.weights import AGE_SHARES, MAX_AGE, PRESETS, age_weights, numbers

#: Years of age in a bin of an interval join.
BIN = 16

REFERENCE_WINDOW = (3, 10)


def constant_ratio(first: int, last: int, preset: str) -> float:
    """Weighted mean of the age curve over ages first..last (1-based years)."""
    curve = PRESETS[preset].curve
    return sum(curve[first - 1 : last]) / sum(AGE_SHARES[first - 1 : last])


def _between(values: Sequence[float], first: Column, last: Column) -> Column:
    sums = numbers(list(accumulate(values, initial=0.0)))
    return F.get(sums, last) - F.get(sums, first - 1)


def window_ratio(
    df: DataFrame,
    lo: str,
    hi: str,
    preset: str = "midpoint",
    path: str = "prefix",
    keys: Sequence[str] = (),
    name: str = "k",
) -> DataFrame:
    """Add the weighted mean of the age curve over the row's age window.

    ``midpoint`` reads lo..hi as ages from lo up to but excluding hi, ``integer`` as the
    years lo..hi inclusive. ``prefix`` looks two running sums up and moves no rows;
    ``range`` joins the windows to the weights on bins of ages and needs the ``keys`` of a row.
    Windows are capped at age 85; an empty one gives NULL.
    """
    last = F.least(F.col(hi), F.lit(MAX_AGE)).cast("int")
    first = (F.col(lo) + (1 if preset == "midpoint" else 0)).cast("int")
    valid = (first >= 1) & (first <= last)
    if path == "prefix":
        ratio = F.try_divide(
            _between(PRESETS[preset].curve, first, last), _between(AGE_SHARES, first, last)
        )
        return df.withColumn(name, F.when(valid, ratio))
    if path != "range":
        raise ValueError(f"unknown path: {path}")
    # the weights are 85 fixed rows
    weights = F.broadcast(age_weights(df.sparkSession, preset).select("age", "w", "pfs"))
    windows = df.where(valid).select(*keys, first.alias("_first"), last.alias("_last"))
    pairs = interval_join(windows, weights, "_first", "_last", "age", width=BIN)
    sums = pairs.groupBy(*keys).agg((F.sum("pfs") / F.sum("w")).alias(name))
    return natural_join(df, sums, "left", on=keys)


def survey_means(surveys: DataFrame) -> DataFrame:
    """Crude prevalence per survey: mean of positives over number among equal surveys."""
    keys = ["study_id", "number", "positives"]
    means = group_mean_ratio(surveys, keys, "positives", "number")
    kept = [name for name in ("study_number", *keys) if name in surveys.columns]
    return means.select(*kept, (F.col("min_age") - 1).alias("mn"), (F.col("max_age") - 1).alias("mx"), "pr")


def clamp(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)))


def standardise_prevalence(
    df: DataFrame,
    lower: int = 2,
    upper: int = 9,
    preset: str = "midpoint",
    path: str = "prefix",
    keys: Sequence[str] = ("study_id",),
    name: str = "pr_std",
) -> DataFrame:
    """Prevalence at ages mn..mx re-expressed at ages lower..upper.

    Adds ``k``, the underlying prevalence ``x`` and the standardised one under ``name``.
    """
    upper = min(upper, MAX_AGE)
    first = lower + 1 if preset == "midpoint" else lower
    target = constant_ratio(first, upper, preset)
    fitted = window_ratio(df, "mn", "mx", preset, path, keys)
    return fitted.withColumn("x", clamp(F.try_divide(F.col("pr"), F.col("k")))).withColumn(name, F.col("x") * target)


def adjust_detection(
    pr: Column, is_rdt: Column, slope: float = DETECTION_SLOPE, intercept: float = DETECTION_INTERCEPT
) -> Column:
    """Prevalence by microscopy mapped to the scale of rapid tests where those were used."""
    mapped = norm_cdf(probit(pr) * slope + intercept)
    return F.when(is_rdt, mapped).when(~is_rdt, pr)


def survey_prevalence(df: DataFrame, p_prime: str = "p_prime") -> DataFrame:
    """Prevalence in the survey's ages, in the reference ages, and by the survey's method."""
    window = window_ratio(df, "min_age", "max_age", "integer", name="_k")
    return window.select(
        *df.columns,
        (F.col(p_prime) * F.col("_k")).alias("pr_survey"),
        (F.col(p_prime) * constant_ratio(*REFERENCE_WINDOW, "integer")).alias("pr_mic"),
    ).withColumn("pr_corrected", adjust_detection(F.col("pr_mic"), F.col("detection_method") == "RDT"))


def point_prevalence(surveys: DataFrame) -> DataFrame:
    """Survey prevalence with the underlying prevalence estimated from the survey itself."""
    window = window_ratio(surveys, "min_age", "max_age", "integer", name="k")
    crude = F.try_divide(F.col("positives").cast("double"), F.col("number").cast("double"))
    return survey_prevalence(window.withColumn("p_prime", clamp(F.try_divide(crude, F.col("k")))))


def drawn_prevalence(study_draws: DataFrame) -> DataFrame:
    """Median and bounds of the corrected prevalence per survey over all draws.

    ``study_draws`` holds the draws of ``p_prime`` beside the facts of each study's survey.
    """
    probs = {"median": 0.5, "q025": 0.025, "q975": 0.975}
    return quantiles(survey_prevalence(study_draws), ["study_number"], "pr_corrected", probs)
