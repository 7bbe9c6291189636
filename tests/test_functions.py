import itertools
import math
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from burdenflow.functions import clinical as c
from burdenflow.functions import rates, special, text

FLAG = [True, False, None]


def values(df, column):
    return [row[column] for row in df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "raw, number",
    [("5y", 5.0), ("1,234 people", 1234.0), ("age -3", -3.0), ("2.5", 2.5), ("none", None), (None, None)],
)
def test_parse_number(spark, raw, number):
    assert one(spark, text.parse_number(F.lit(raw).cast("string"))) == number


def test_part_names(spark):
    row = spark.sql("SELECT 'Kilifi B 2006-07' AS id").select(
        text.period_of(F.col("id")).alias("period"), text.site_of(F.col("id"), text.period_of(F.col("id"))).alias("site")
    )
    assert row.first().asDict() == {"period": "2006-07", "site": "Kilifi B"}
    assert one(spark, text.site_of(F.lit("Other"), F.lit("2006-07"))) == "Other"


def test_ages_and_indexes(spark):
    ages = spark.sql("SELECT * FROM VALUES ('3m-11m'), ('4y'), (NULL) AS t(a)")
    assert values(ages.select(text.age_of(F.col("a")).alias("v")), "v") == [0, 4, None]
    names = spark.sql("SELECT * FROM VALUES ('PR[12]'), ('beta1[3]'), ('sigma') AS t(a)")
    assert values(names.select(text.parameter_index(F.col("a")).alias("v")), "v") == [12, 3, None]


def test_missing_key_parts_show(spark):
    assert one(spark, text.study_id(F.lit(None).cast("string"), F.lit("2006-07"))) == "NA 2006-07"


def test_split_site(spark):
    rows = spark.sql("SELECT * FROM VALUES ('A, Ke nya'), ('B'), ('C, D, E') AS t(site)")
    assert [tuple(r) for r in text.split_site(rows).select("site", "country").collect()] == [
        ("A", "Kenya"), ("B", None), ("C", "D"),
    ]


def test_flag_decoding(spark):
    rows = spark.sql("SELECT * FROM VALUES ('Y'), ('N'), ('?'), (NULL) AS t(f)")
    got = rows.select(
        c.yes_no(F.col("f")).alias("strict"), c.yes_no_lenient(F.col("f")).alias("lenient"),
        c.yes_lenient(F.col("f")).alias("only_yes"), c.not_in(F.col("f"), ["N"]).alias("not_no"),
    ).collect()
    assert [tuple(r) for r in got] == [
        (True, "TRUE", "TRUE", True), (False, "FALSE", "N", False), (None, "?", "?", True), (None, None, None, True),
    ]


def test_outcome_label(spark):
    rows = spark.sql("SELECT * FROM VALUES ('A'), ('D'), ('Unknown'), ('T'), (NULL) AS t(o)")
    got = values(rows.select(c.outcome_label(F.col("o")).alias("v")), "v")
    assert got == ["Absconded", "Discharged", None, "T", None]


def test_evidence_class_cells(spark):
    for bt, pallor in itertools.product(FLAG, ["Severe", "Mild", None]):
        got = one(spark, c.evidence_class4(F.lit(bt).cast("boolean"), F.lit(pallor).cast("string")))
        assert got == 1 + bool(bt) + 2 * (pallor == "Severe")
    assert [one(spark, c.evidence_class2(F.lit(v).cast("boolean"))) for v in FLAG] == [2, 1, 1]


def three_valued_or(*flags):
    return True if True in flags else None if None in flags else False


def test_cerebral_flag_truth_table(spark):
    cells = [
        (b, a, u, three_valued_or(None if b is None else b < 3, None if a is None else a == "U", u))
        for b, a, u in itertools.product([1, 5, None], ["U", "A", None], FLAG)
    ]
    df = spark.createDataFrame(cells, "bcs int, apvu string, unconscious boolean, want boolean")
    got = df.select(c.cerebral(F.col("bcs"), F.col("apvu"), F.col("unconscious")).alias("got"), "want").collect()
    assert len(got) == 27 and all(r.got == r.want for r in got)


def test_composite_uses_decided_cerebral_flag(spark):
    row = spark.sql(
        """SELECT 9D AS hb_level, false AS deep_breathing, CAST(NULL AS INT) AS bcs, CAST(NULL AS STRING) AS apvu,
        CAST(NULL AS BOOLEAN) AS unconscious, 'Severe' AS pallor, false AS transfusion, false AS intercostal_recession"""
    )
    open_, closed = c.case_flags(row).first(), c.case_flags(row, cm_default=False).first()
    assert (open_.cm, open_.composite, closed.cm, closed.composite, closed.composite_alt) == (None, None, False, False, True)


def test_age_bands_start_at_three_months(spark):
    rows = spark.sql("SELECT * FROM VALUES (0), (1), (9), (NULL) AS t(age_years)")
    got = [tuple(r)[1:] for r in c.age_bands(rows).collect()]
    assert got == [(0.0, 0.75, 0.75), (0.75, 1.75, 1.0), (8.75, 9.75, 1.0), (None, None, None)]


def test_survey_bounds_round_half_even(spark):
    rows = spark.sql("SELECT * FROM VALUES (0.5D, 2.5D), (1.5D, 101D) AS t(min_age, max_age)")
    assert [tuple(r) for r in c.survey_bounds(rows).collect()] == [(1, 3), (3, 85)]


def test_rate_has_no_infinity(spark):
    assert one(spark, c.rate(F.lit(3), F.lit(0.0))) is None


def test_normal_functions(spark):
    normal = statistics.NormalDist()
    ps = [10.0**-k for k in range(1, 12)] + [k / 200 for k in range(1, 200)] + [1 - 1e-6]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", special.probit(F.col("p")).alias("q")).collect()
    assert max(abs(normal.inv_cdf(r.p) - r.q) for r in rows) < 1e-13
    rows = spark.createDataFrame([(k / 10,) for k in range(-80, 81)], "x double")
    rows = rows.select("x", special.norm_cdf(F.col("x")).alias("p")).collect()
    assert max(abs(normal.cdf(r.x) - r.p) for r in rows) < 1e-15


def test_gamma_functions(spark):
    for x in (0.5, 1.5, 7.0, 123.4, 1e6):
        assert one(spark, special.lgamma(F.lit(x))) == pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-13)
    scale = one(spark, special.gamma_log_scale(F.lit(3.0), F.lit(2.0)))
    assert scale == pytest.approx(3 * math.log(2.0) - math.lgamma(3), rel=1e-12)


def binomial_tail(x, a, b):
    """Beta distribution function for whole parameters, summed exactly."""
    n, x = a + b - 1, Fraction(x)
    return float(sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1)))


def test_beta_functions(spark):
    pairs = [(1, 1), (1, 2), (5, 1), (1, 400), (30, 70), (300, 450)]
    rows = spark.createDataFrame([(k / 16, float(a), float(b)) for k in range(1, 16) for a, b in pairs], "x double, a double, b double")
    for r in rows.select("*", special.beta_cdf(F.col("x"), F.col("a"), F.col("b")).alias("p")).collect():
        assert r.p == pytest.approx(binomial_tail(r.x, int(r.a), int(r.b)), abs=1e-13)
    ps = [1e-9, 1e-4, 0.025, 0.3, 0.5, 0.9, 0.975, 1 - 1e-9]
    pairs += [(3000, 9000), (1, 30000), (10**6, 3 * 10**6), (0.5, 0.5), (0.75, 40.0)]
    # with b = 0.5 the largest of these lies nearer to 1 than doubles do
    grid = [(p, float(a), float(b)) for p in ps for a, b in pairs if b >= 1 or p < 0.999]
    rows = spark.createDataFrame(grid, "p double, a double, b double")
    quantile = rows.withColumn("x", special.beta_quantile(F.col("p"), F.col("a"), F.col("b")))
    for r in quantile.withColumn("back", special.beta_cdf(F.col("x"), F.col("a"), F.col("b"))).collect():
        assert 0 < r.x < 1 and r.back == pytest.approx(r.p, abs=1e-9)
    assert one(spark, special.beta_quantile(F.lit(0.5), F.lit(1.0), F.lit(2.0))) == pytest.approx(1 - math.sqrt(0.5), abs=1e-14)
    # the arcsine law
    assert one(spark, special.beta_quantile(F.lit(0.2), F.lit(0.5), F.lit(0.5))) == pytest.approx(math.sin(math.pi * 0.1) ** 2, abs=1e-13)
    for p in (0.0, 1.0, None):
        assert one(spark, special.beta_quantile(F.lit(p).cast("double"), F.lit(2.0), F.lit(3.0))) is None
    assert one(spark, special.beta_cdf(F.lit(-1.0), F.lit(2.0), F.lit(3.0))) == 0.0
    assert one(spark, special.beta_cdf(F.lit(2.0), F.lit(2.0), F.lit(3.0))) == 1.0


def test_log_likelihoods(spark):
    got = one(spark, rates.log_lik("poisson", F.lit(4.0), F.lit(2.5)))
    assert got == pytest.approx(4 * math.log(2.5) - 2.5 - math.log(24), rel=1e-12)
    nb = one(spark, rates.log_lik("negbin", F.lit(4.0), F.lit(2.5), F.lit(3.0)))
    want = math.lgamma(7) - math.lgamma(3) - math.log(24) + 3 * math.log(3 / 5.5) + 4 * math.log(2.5 / 5.5)
    assert nb == pytest.approx(want, rel=1e-12)


def test_correction_of_empty_estimate(spark):
    assert one(spark, rates.correction(F.lit(3.0), F.lit(0.0))) == 1.0
    assert one(spark, rates.correction(F.lit(3.0), F.lit(4.0))) == 0.75
