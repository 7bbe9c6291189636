"""Observed and imputed admissions per study, age and evidence class."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from burdenflow.functions import clinical as c
from burdenflow.functions.special import beta_quantile
from burdenflow.operators.groups import (
    case_counts,
    flag_sum,
    known_evidence,
    null_sum_distinct,
    unknown_counts,
)
from burdenflow.operators.joins import lookup, natural_join
from burdenflow.operators.ordering import number_rows
from burdenflow.plans.cleaning import evidence

CLASSES = {"sma": [1, 2, 3, 4], "rd": [1, 2]}
CLASS_COLUMN = {"sma": "class_sma", "rd": "class_rd"}
BOUNDS = {"median": 0.5, "q025": 0.025, "q975": 0.975}


def classed(patients: DataFrame) -> DataFrame:
    """Patients with the evidence classes that stand in for an unknown status."""
    return patients.withColumns(
        {
            "class_sma": c.evidence_class4(F.col("transfusion"), F.col("pallor")),
            "class_rd": c.evidence_class2(F.col("intercostal_recession")),
        }
    )


def phenotype_counts(patients: DataFrame, phenotype: str, population: DataFrame) -> DataFrame:
    """Cases and rate per study for sma, rd, cm or composite.

    Only cerebral cases leave patients without any evidence out before counting, so a study
    without evidence has no row. The composite takes an undecided cerebral status as no.
    """
    flagged = c.case_flags(patients, cm_default=False if phenotype == "composite" else None)
    if phenotype == "cm":
        flagged = known_evidence(flagged, evidence(flagged, "cm"))
    return case_counts(flagged, phenotype, population)


def evidence_counts(counts: DataFrame, phenotypes: Sequence[str] = ("sma", "rd")) -> DataFrame:
    """Positives and patients of known status per phenotype, study and evidence class, from ``status_counts``.

    Every row of the counts serves all phenotypes, so the patients are read once.
    """
    marks = F.array(
        *[
            F.struct(
                F.lit(p).alias("phenotype"), F.col(CLASS_COLUMN[p]).alias("class"), F.col(p).alias("status"),
                F.col(f"evidence_{p}").alias("evidence"),
            )
            for p in phenotypes
        ]
    )
    known = counts.select("study_id", "patients", F.inline(marks)).where(F.col("evidence") & F.col("status").isNotNull())
    return known.groupBy("phenotype", "study_id", "class").agg(
        F.sum(F.col("status").cast("int") * F.col("patients")).alias("n_positives"), F.sum("patients").alias("n_patients")
    )


def undiagnosed(patients: DataFrame, phenotype: str) -> DataFrame:
    """Patients of unknown status per study, a column per evidence class."""
    rows = known_evidence(classed(c.case_flags(patients)), evidence(patients, phenotype))
    return unknown_counts(rows, phenotype, CLASS_COLUMN[phenotype], CLASSES[phenotype])


def class_positivity(counts: DataFrame, keys: Sequence[str] = ("class",)) -> DataFrame:
    """Mean, variance, median and 95 % bounds of each class's positivity under a flat prior.

    This is the conjugate part alone; a joint fit would also learn from the admissions.
    """
    a, b = F.col("n_positives") + 1.0, F.col("n_patients") - F.col("n_positives") + 1.0
    totals = counts.groupBy(*keys).agg(F.sum("n_positives").alias("n_positives"), F.sum("n_patients").alias("n_patients"))
    return totals.withColumns(
        {
            "rate_mean": a / (a + b),
            "rate_var": a * b / ((a + b) * (a + b) * (a + b + 1)),
            **{f"rate_{name}": beta_quantile(F.lit(p), a, b) for name, p in BOUNDS.items()},
        }
    )


def status_counts(patients: DataFrame, keys: Sequence[str] = ("study_id",)) -> DataFrame:
    """Patients per group and combination of statuses, classes and evidence.

    A group has some dozens of rows however many patients it has. What follows reads these
    counts several times; the shuffle that made them is used again.
    """
    flagged = classed(c.case_flags(patients, cm_default=False))
    for phenotype in ("sma", "rd"):
        known = [F.col(column).isNotNull() for column in evidence(patients, phenotype)]
        flagged = flagged.withColumn(f"evidence_{phenotype}", reduce(Column.__or__, known))
    marks = ["sma", "rd", "cm", "class_sma", "class_rd", "evidence_sma", "evidence_rd"]
    return flagged.groupBy(*keys, *marks).agg(F.count(F.lit(1)).alias("patients"))


def _class_rates(counts: DataFrame, phenotype: str) -> DataFrame:
    """Positivity of each class, under the name ``rate_<phenotype>``."""
    known = counts.where(F.col(phenotype).isNotNull()).groupBy(F.col(CLASS_COLUMN[phenotype]).alias("class")).agg(
        F.sum(F.col(phenotype).cast("int") * F.col("patients")).alias("n_positives"),
        F.sum("patients").alias("n_patients"),
    )
    rates = class_positivity(known).select("class", F.col("rate_mean").alias(f"rate_{phenotype}"))
    # one row per evidence class, of which there are four or two
    return F.broadcast(rates)


def _rated(counts: DataFrame, phenotype: str) -> DataFrame:
    return lookup(counts, _class_rates(counts, phenotype), {CLASS_COLUMN[phenotype]: "class"})


def _patients_where(condition: Column, weight: Column | None = None) -> Column:
    amount = F.col("patients") if weight is None else F.col("patients") * weight
    return F.sum(F.when(condition, amount))


def imputed_admissions(patients: DataFrame, phenotype: str, population: DataFrame) -> DataFrame:
    """Observed cases plus the expected cases among patients of unknown status with evidence.

    A class without any known patient has the prior mean one half.
    """
    rated = _rated(status_counts(patients), phenotype)
    unknown = F.col(phenotype).isNull() & F.col(f"evidence_{phenotype}")
    rate = F.coalesce(F.col(f"rate_{phenotype}"), F.lit(0.5))
    totals = rated.groupBy("study_id").agg(
        F.coalesce(_patients_where(F.col(phenotype)), F.lit(0)).alias("n"),
        F.coalesce(_patients_where(unknown), F.lit(0)).alias("unknown"),
        F.coalesce(_patients_where(unknown, rate), F.lit(0.0)).alias("imputed"),
    )
    joined = natural_join(totals, population, "left", on=["study_id"], null_safe=False)
    estimated = F.col("n") + F.col("imputed")
    return joined.select(
        "study_id", "n", "unknown", estimated.alias("estimated"), "py",
        c.rate(estimated, F.col("py")).alias("rate_estimated"),
    )


def composite_imputed(patients: DataFrame, keys: Sequence[str] = ("study_id",)) -> DataFrame:
    """Expected patients with any of the three phenotypes, unknown statuses at class rates."""
    rated = _rated(_rated(status_counts(patients, keys), "sma"), "rd")
    share = lambda p: F.coalesce(F.col(p).cast("double"), F.col(f"rate_{p}"), F.lit(0.5))
    any_case = 1 - (1 - share("sma")) * (1 - share("rd")) * (1 - F.col("cm").cast("double"))
    return rated.groupBy(*keys).agg(
        F.coalesce(_patients_where(F.col("sma") | F.col("rd") | F.col("cm")), F.lit(0)).alias("observed"),
        F.sum("patients").alias("patients"),
        F.sum(any_case * F.col("patients")).alias("estimated"),
    )


def seeded_uniform(*key: Column) -> Column:
    """A number inside (0, 1) from a digest of the key, so that a run can be repeated."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in key]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0**48)


def drawn_class_rates(counts: DataFrame, phenotype: str, draws: int, seed: int) -> DataFrame:
    """``rates_<phenotype>`` of each class: an array of draws of its positivity, from ``status_counts``.

    A class without any known patient is drawn from the flat prior.
    """
    known = F.col(phenotype).isNotNull()
    totals = counts.groupBy(F.col(CLASS_COLUMN[phenotype]).alias("class")).agg(
        F.coalesce(_patients_where(F.col(phenotype)), F.lit(0)).alias("positives"),
        F.coalesce(_patients_where(known), F.lit(0)).alias("known"),
    )
    cores = counts.sparkSession.sparkContext.defaultParallelism
    dealt = totals.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).repartition(cores, "class", "draw")
    uniform = seeded_uniform(F.lit(seed), F.lit(phenotype), F.col("class"), F.col("draw"))
    rate = beta_quantile(uniform, F.col("positives") + 1.0, F.col("known") - F.col("positives") + 1.0)
    rates = dealt.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("draw", rate.alias("rate")))).alias("drawn"))
    # one row of `draws` numbers per evidence class, of which there are four or two
    return F.broadcast(rates.select("class", F.transform("drawn", lambda x: x["rate"]).alias(f"rates_{phenotype}")))


def composite_imputed_draws(
    patients: DataFrame, keys: Sequence[str] = ("study_id",), draws: int = 100, seed: int = 1
) -> DataFrame:
    """Expected patients with any of the three phenotypes, as median and 95 % bounds over draws of the class rates.

    Within a draw all groups share the rates, as in a joint fit. Combinations of statuses and classes meet the draws,
    not patients; those that no draw changes are one row (draw 0) of their group.
    """
    counts = status_counts(patients, keys)
    rated = counts
    for phenotype in ("sma", "rd"):
        rates = drawn_class_rates(counts, phenotype, draws, seed)
        rated = lookup(rated, rates, {CLASS_COLUMN[phenotype]: "class"})
    seen = F.coalesce(F.col("sma") | F.col("rd") | F.col("cm"), F.lit(False))
    decided = seen | (F.col("sma").isNotNull() & F.col("rd").isNotNull())
    drawn = lambda p, i: F.when(F.col(p).isNotNull(), F.col(p).cast("double")).otherwise(
        F.coalesce(F.get(f"rates_{p}", i - 1), F.lit(0.5))
    )
    expected = lambda i: (1 - (1 - drawn("sma", i)) * (1 - drawn("rd", i))) * F.col("patients")
    part = lambda i, observed, patients, cases: F.struct(
        i.alias("draw"), observed.alias("observed"), patients.alias("patients"), cases.alias("cases")
    )
    none = F.lit(0).cast("long")
    fixed = F.array(part(F.lit(0), F.when(seen, F.col("patients")).otherwise(none), F.col("patients"), F.lit(0.0)))
    uncertain = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda i: part(i, none, none, expected(i)))
    parts = F.when(decided, fixed).otherwise(F.concat(fixed, uncertain))
    by_draw = rated.select(*keys, F.inline(parts)).groupBy(*keys, "draw").agg(
        F.sum("observed").alias("observed"), F.sum("patients").alias("patients"), F.sum("cases").alias("cases")
    )
    across = F.percentile(F.when(F.col("draw") > 0, F.col("cases")), F.array(*map(F.lit, BOUNDS.values())))
    totals = by_draw.groupBy(*keys).agg(
        F.sum("observed").alias("observed"), F.sum("patients").alias("patients"), across.alias("across")
    )
    bound = lambda at: F.col("observed") + F.coalesce(F.get("across", F.lit(at)), F.lit(0.0))
    return totals.select(
        *keys, "observed", "patients", *[bound(at).alias(f"estimated_{name}") for at, name in enumerate(BOUNDS)]
    )


def _age_counts(patients: DataFrame) -> DataFrame:
    """Composite cases by study and age, counted before anything is joined to them."""
    return c.case_flags(patients, cm_default=False).groupBy("study_id", "age_years").agg(
        flag_sum(F.col("composite")).alias("n"), flag_sum(F.col("composite_alt")).alias("n_alt")
    )


def _age_rates(counts: DataFrame, populations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cases and rates per group of studies and ages; person-years are those of the distinct populations."""
    aged = natural_join(counts, populations, "left", on=["study_id", "age_years"])
    totals = aged.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("n_alt").alias("n_alt"), null_sum_distinct(F.col("n_age")).alias("py")
    )
    return totals.withColumns(
        {"rate": c.rate(F.col("n"), F.col("py")), "rate_alt": c.rate(F.col("n_alt"), F.col("py"))}
    )


def band_rates(patients: DataFrame, populations: DataFrame, prevalence: DataFrame, width: float) -> DataFrame:
    """Composite cases and rates per age and prevalence band of the study."""
    studies = prevalence.select("study_id", "pr")
    placed = natural_join(_age_counts(patients), studies, "left", on=["study_id"], null_safe=False)
    banded = placed.withColumn("band", F.floor(F.col("pr") / F.lit(width)))
    return c.age_bands(_age_rates(banded, populations, ["age_years", "band"]))


def site_age_cases(patients: DataFrame, populations: DataFrame) -> DataFrame:
    """Composite cases and rates per study and age, numbered in that order."""
    rates = _age_rates(_age_counts(patients), populations, ["study_id", "age_years"])
    # an unknown age sorts after the known ones
    placed = rates.withColumn("_place", F.coalesce("age_years", F.lit(1000)))
    return number_rows(placed, ["study_id", "_place"]).drop("_place")
