"""Clinical recodes and case definitions under three-valued logic.

A flag that cannot be decided stays NULL. ``when`` chains have no ``otherwise`` where a
missing input must give a missing output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HB_LIMIT = 5
COMA_LIMIT = 3


def yes_no(c: Column, yes: str = "Y", no: str = "N") -> Column:
    """Y gives true, N gives false, anything else NULL."""
    return F.when(c == yes, F.lit(True)).when(c == no, F.lit(False))


def yes_no_lenient(c: Column) -> Column:
    """Y and N become TRUE and FALSE texts; every other value is kept as it is."""
    return F.when(c == "Y", F.lit("TRUE")).when(c == "N", F.lit("FALSE")).otherwise(c)


def yes_lenient(c: Column) -> Column:
    """Y becomes the text TRUE; every other value, also NULL, is kept."""
    return F.when(c == "Y", F.lit("TRUE")).otherwise(c)


def outcome_label(c: Column) -> Column:
    return (
        F.when(c == "A", F.lit("Absconded"))
        .when(c == "D", F.lit("Discharged"))
        .when(c == "Unknown", F.lit(None))
        .otherwise(c)
    )


def not_in(c: Column, values: list[str]) -> Column:
    """Membership test that is never NULL: a missing value is not a member."""
    return ~F.coalesce(c.isin(values), F.lit(False))


def null_to_zero(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def anaemia(hb: Column) -> Column:
    return hb < HB_LIMIT


def cerebral(bcs: Column, apvu: Column, unconscious: Column) -> Column:
    return (bcs < COMA_LIMIT) | (apvu == "U") | unconscious


def raw_flags(df: DataFrame) -> DataFrame:
    """0/1 flags straight from the raw codes; an undecided flag counts as 0.

    ``anemia_raw`` tests that the code is present, not what it says.
    """
    coma = cerebral(F.col("bcs"), F.col("apvu"), F.col("unconscious") == "Y")
    return df.withColumns(
        {
            "cerebral_raw": null_to_zero(coma),
            "anemia_raw": F.col("sma").isNotNull().cast("int"),
            "respiratory_raw": null_to_zero(F.col("deep_breathing") == "Y"),
        }
    )


def case_flags(df: DataFrame, cm_default: bool | None = None) -> DataFrame:
    """Add sma, rd, cm, composite and composite_alt to cleaned admissions.

    ``cm_default=False`` decides an undecided cerebral flag as false before it enters the
    composite, as the composite analyses do.
    """
    cm = cerebral(F.col("bcs"), F.col("apvu"), F.col("unconscious"))
    if cm_default is not None:
        cm = F.coalesce(cm, F.lit(cm_default))
    flagged = df.withColumns(
        {"sma": anaemia(F.col("hb_level")), "rd": F.col("deep_breathing"), "cm": cm}
    )
    any_case = F.col("sma") | F.col("rd") | F.col("cm")
    signs = (F.col("pallor") == "Severe") | F.col("transfusion") | F.col("intercostal_recession")
    return flagged.withColumns({"composite": any_case, "composite_alt": any_case | signs})


def evidence_class4(transfusion: Column, pallor: Column) -> Column:
    """1 no sign, 2 transfused, 3 severe pallor, 4 both; unknown signs count as absent."""
    bt = F.coalesce(transfusion, F.lit(False)).cast("int")
    severe = F.coalesce(pallor == "Severe", F.lit(False)).cast("int")
    return F.lit(1) + bt + 2 * severe


def evidence_class2(recession: Column) -> Column:
    return F.lit(1) + F.coalesce(recession, F.lit(False)).cast("int")


def rate(n: Column, py: Column, per: int = 1000) -> Column:
    return F.try_divide(n.cast("double"), py) * per


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(c: Column) -> Column:
    return c * 100


def age_bands(df: DataFrame, column: str = "age_years") -> DataFrame:
    """Band of an age in completed years; bands start at three months of age."""
    age = F.col(column)
    return (
        df.withColumn("age_start", F.when(age == 0, F.lit(0.0)).otherwise(age - 0.25))
        .withColumn("age_end", F.when(F.col("age_start") == 0, F.lit(0.75)).otherwise(F.col("age_start") + 1))
        .withColumn("age_width", F.when(F.col("age_start") == 0, F.lit(0.75)).when(age.isNotNull(), F.lit(1.0)))
    )


def survey_bounds(df: DataFrame, cap: int = 85) -> DataFrame:
    """Survey ages as 1-based whole-year bounds: half-even rounding, plus one, capped."""
    return df.withColumn("min_age", (F.bround("min_age") + 1).cast("int")).withColumn(
        "max_age", F.least(F.bround("max_age") + 1, F.lit(cap)).cast("int")
    )
