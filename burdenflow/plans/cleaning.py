"""Cleaning of raw admissions, locations and age populations into one analysis table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from burdenflow.functions import clinical as c
from burdenflow.functions.text import age_of, period_of, site_of, split_site, study_id
from burdenflow.operators.groups import group_total, null_sum
from burdenflow.operators.joins import natural_join
from burdenflow.operators.ordering import number_rows
from burdenflow.operators.shaping import append, recode
from burdenflow.sources.tables import kept

# fixed values: spellings of sites, periods and methods
LONG_NAMES = {
    "Kadzinuni-Mauveni": "Kadziununi-Mauveni (Kilifi C)",
    "Junju": "Junju (Kilifi B)",
    "Ngerenya": "Ngerenya (Kilifi A)",
}
SHORT_NAMES = {
    "Junju (Kilifi B)": "Kilifi B",
    "Kadziununi-Mauveni (Kilifi C)": "Kilifi C",
    "Ngerenya (Kilifi A)": "Kilifi A",
}
PERIOD_REPAIR = {"2006-2007": "2006-07"}
POOLED_SITE, POOLED_PERIOD, POOLED_SPAN = "Kadziununi-Mauveni (Kilifi C)", "2018-19", "2017-19"
METHOD_REPAIR = {"Microsopy": "Microscopy"}
NO_SPRAYING = ["[N]", "N"]


def clean_admissions(raw: DataFrame, period_repair: Mapping[str, str] = PERIOD_REPAIR) -> DataFrame:
    """Decode the raw admission codes; columns as in ``schemas.ADMISSIONS``."""
    named = recode(recode(raw, "site", LONG_NAMES), "period", period_repair)
    pooled = F.when(F.col("site") == POOLED_SITE, F.lit(POOLED_PERIOD)).otherwise(F.col("period"))
    flags = [
        "convulsions", "nasal_flaring", "intercostal_recession", "deep_breathing", "unconscious", "transfusion",
    ]
    return named.withColumn("period", pooled).withColumns(
        {
            "sex": F.lower("sex"),
            "fever": c.yes_no_lenient(F.col("fever")),
            **{name: c.yes_no(F.col(name)) for name in flags},
            "sma": c.yes_lenient(F.col("sma")),
            "outcome": c.outcome_label(F.col("outcome")),
        }
    )


def format_locations(raw: DataFrame) -> DataFrame:
    """Site features with the spraying flag and crude prevalence; the names are already long."""
    return (
        raw.withColumn("irs", c.not_in(F.col("irs"), NO_SPRAYING))
        .withColumn("pr", c.percent(c.ratio(F.col("n_positive"), F.col("n_examined"))))
        .withColumn("r", c.ratio(F.col("pr"), F.col("pr_c")))
    )


def read_population(*parts: DataFrame) -> DataFrame:
    """Stack the age sheets and read site, period and age from their texts."""
    period = period_of(F.col("file_id"))
    read = append(*parts).select(
        site_of(F.col("file_id"), period).alias("site"),
        period.alias("period"),
        age_of(F.col("age")).alias("age_years"),
        F.col("pyor").alias("n_age"),
    )
    named = recode(read, "site", LONG_NAMES)
    pooled = (F.col("period") == POOLED_SPAN) & (F.col("site") == POOLED_SITE)
    return named.withColumn("period", F.when(pooled, F.lit(POOLED_PERIOD)).otherwise(F.col("period")))


def age_population(*parts: DataFrame) -> DataFrame:
    """Population by study and age, and the study's total: missing when any of its ages is."""
    return group_total(read_population(*parts), ["site", "period"], "n_age", "total_population")


def build_complete(
    admissions: DataFrame,
    locations: DataFrame,
    populations: DataFrame,
) -> DataFrame:
    """Cleaned admissions with the features of their site and the population of their age.

    The study tables are written first: their sizes, then known when the joins are planned, decide whether they are
    broadcast or shuffled. Sizes known at run time only come too late to spare the admissions a shuffle of whole rows.
    """
    # merges nothing, but ends a stage of generated code: cleaning and both joins as one method (8,489 bytes) are beyond
    # the 8,000 that the JVM compiles
    cleaned = admissions.coalesce(2**31 - 1)
    placed = natural_join(cleaned, kept(locations, "locations"), "left", on=["site", "period"])
    return natural_join(placed, kept(populations, "populations"), "left", on=["site", "period", "age_years"])


def study_rows(df: DataFrame) -> DataFrame:
    """Short site names and the study key."""
    return recode(df, "site", SHORT_NAMES).withColumn("study_id", study_id(F.col("site"), F.col("period")))


def study_dim(df: DataFrame) -> DataFrame:
    """One row per study with its number: the rank of its key among all studies."""
    return number_rows(df.select("study_id", "site", "period").distinct(), ["study_id"], name="study_number")


def study_populations(populations: DataFrame) -> DataFrame:
    """Person-years per study, and none for a study with an unknown population."""
    return study_rows(populations).groupBy("study_id").agg(null_sum(F.col("n_age")).alias("py"))


def detection_methods(locations: DataFrame) -> DataFrame:
    """Detection method per study under short site names, spelling repaired."""
    methods = locations.select("site", "period", "detection_method").distinct()
    return recode(recode(methods, "site", SHORT_NAMES), "detection_method", METHOD_REPAIR)


def survey_rows(raw: DataFrame, methods: DataFrame) -> DataFrame:
    """Surveys with study key, whole-year age bounds and detection method."""
    keyed = study_rows(c.survey_bounds(split_site(raw)))
    located = natural_join(keyed, methods, "left", on=["site", "period"])
    return located.select(
        "study_id", "site", "country", "period", "min_age", "max_age", "number", "positives", "detection_method"
    )


def format_surveys(raw: DataFrame, methods: DataFrame, studies: DataFrame) -> DataFrame:
    """Surveys as in ``survey_rows`` with the number their study has in the one dimension ``studies``."""
    rows = natural_join(survey_rows(raw, methods), numbers_of(studies), "left", on=["study_id"], null_safe=False)
    return rows.select("study_number", *[name for name in rows.columns if name != "study_number"])


def numbers_of(studies: DataFrame) -> DataFrame:
    """Key and number of every study."""
    return studies.select("study_id", "study_number")


def evidence(df: DataFrame, phenotype: str) -> list[str]:
    """Columns of which at least one must be known for a patient to count."""
    return {
        "sma": ["hb_level", "pallor", "transfusion"],
        "rd": ["deep_breathing", "intercostal_recession"],
        "cm": ["apvu", "unconscious", "bcs"],
    }[phenotype]
