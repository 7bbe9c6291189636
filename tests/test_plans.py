import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from burdenflow.catalogue.queries import REGISTRY
from burdenflow.functions import clinical
from burdenflow.plans import burden, cleaning, posterior, prevalence, regression
from burdenflow.sources.tables import store_bucketed
from burdenflow.sources.weights import AGE_SHARES, PRESETS, age_weights

# worked examples of the closed form: window, prevalence, window mean, standardised at 2-9 and 0-85
GOLDEN = [
    (1, 10, 0.1, 0.99034405, 0.10077260, 0.07688196),
    (2, 20, 0.2, 0.93224183, 0.21410656, 0.16334730),
    (3, 30, 0.3, 0.86276204, 0.34702343, 0.26475294),
    (4, 40, 0.4, 0.79862001, 0.49985999, 0.38135581),
    (5, 50, 0.5, 0.75401693, 0.66178585, 0.50489314),
    (0, 1, 0.95, 0.59498756, 0.99799547, 0.76139595),
    (20, 40, 0.9, 0.53084737, 0.99799547, 0.76139595),
]


@pytest.mark.parametrize("path", ["prefix", "range"])
def test_standardised_prevalence(spark, path):
    rows = [(str(i), *row[:3]) for i, row in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "study_id string, mn int, mx int, pr double")
    near = {r.study_id: r for r in prevalence.standardise_prevalence(df, 2, 9, path=path).collect()}
    wide = {r.study_id: r for r in prevalence.standardise_prevalence(df, 0, 85, path=path).collect()}
    for i, (*_, k, at_2_9, at_all) in enumerate(GOLDEN):
        assert near[str(i)].k == pytest.approx(k, abs=1e-8)
        assert near[str(i)].pr_std == pytest.approx(at_2_9, abs=1e-8)
        assert wide[str(i)].pr_std == pytest.approx(at_all, abs=1e-8)


def test_windows_are_checked_and_capped(spark):
    df = spark.createDataFrame([("a", 5, 5), ("b", 80, 101), ("c", 84, 85)], "study_id string, mn int, mx int")
    for path in ("prefix", "range"):
        got = {r.study_id: r.k for r in prevalence.window_ratio(df, "mn", "mx", path=path, keys=["study_id"]).collect()}
        assert got["a"] is None and 0 < got["b"] < 1
        assert got["c"] == pytest.approx(PRESETS["midpoint"].curve[84] / AGE_SHARES[84])


@pytest.mark.parametrize("preset, last", [("midpoint", 0.7613959493442148), ("integer", 0.7976546171923528)])
def test_age_curve_table(spark, preset, last):
    rows = sorted(age_weights(spark, preset).collect(), key=lambda r: r.age)
    assert [r.age for r in rows] == list(range(1, 86))
    assert rows[-1].cum_pfs / rows[-1].cum_w == pytest.approx(last, abs=1e-12)
    assert sum(r.pfs for r in rows) == pytest.approx(rows[-1].cum_pfs, abs=1e-12)
    assert [r.pfs for r in rows] == pytest.approx(PRESETS[preset].curve, abs=1e-15)


def test_detection_map(spark):
    want = {0.01: 0.006632813914397906, 0.1: 0.07171932242401219, 0.3: 0.23310223373214195, 0.5: 0.4129355773517854}
    df = spark.createDataFrame([(p,) for p in want], "p double")
    got = df.select("p", prevalence.adjust_detection(F.col("p"), F.lit(True)).alias("q")).collect()
    assert {r.p: pytest.approx(r.q, abs=1e-12) for r in got} == want
    plain = df.select("p", prevalence.adjust_detection(F.col("p"), F.lit(False)).alias("q")).collect()
    assert all(r.p == r.q for r in plain)


ADMISSIONS = """site STRING, period STRING, sex STRING, fever STRING, convulsions STRING, nasal_flaring STRING,
    intercostal_recession STRING, deep_breathing STRING, unconscious STRING, transfusion STRING, sma STRING, outcome STRING"""


def test_cleaning_repairs_names_and_periods(spark):
    rows = [
        ("Junju", "2006-2007", "M", "Y", "Y", "N", "x", None, "Y", "N", "Y", "A"),
        ("Kadzinuni-Mauveni", "2010-11", "F", "unk", "N", "N", "N", "N", "N", "Y", None, "Unknown"),
    ]
    a, b = cleaning.clean_admissions(spark.createDataFrame(rows, ADMISSIONS)).orderBy("sex", ascending=False).collect()
    assert (a.site, a.period, a.sex, a.fever, a.intercostal_recession, a.deep_breathing, a.sma, a.outcome) == (
        "Junju (Kilifi B)", "2006-07", "m", "TRUE", None, None, "TRUE", "Absconded",
    )
    assert (b.site, b.period, b.fever, b.transfusion, b.sma, b.outcome) == (
        "Kadziununi-Mauveni (Kilifi C)", "2018-19", "unk", True, None, None,
    )


def test_population_total_is_missing_when_an_age_is(spark):
    parts = [
        spark.createDataFrame([("Junju 2006-07", "3m-11m", 10.0), ("Junju 2006-07", "1y", 20.0)], "file_id string, age string, pyor double"),
        spark.createDataFrame([("X 2006-07", "2y", None), ("X 2006-07", "3y", 5.0)], "file_id string, age string, pyor double"),
    ]
    got = {(r.site, r.age_years): r.total_population for r in cleaning.age_population(*parts).collect()}
    assert got == {("Junju (Kilifi B)", 0): 30.0, ("Junju (Kilifi B)", 1): 30.0, ("X", 2): None, ("X", 3): None}


def test_complete_table_matches_missing_ages(spark):
    adm = spark.createDataFrame([("A", "p", None), ("A", "p", 1), ("B", "p", 1)], "site string, period string, age_years int")
    loc = spark.createDataFrame([("A", "p", "RDT")], "site string, period string, detection_method string")
    pop = spark.createDataFrame([("A", "p", None, 7.0), ("A", "p", 1, 8.0)], "site string, period string, age_years int, n_age double")
    got = {(r.site, r.age_years): (r.detection_method, r.n_age) for r in cleaning.build_complete(adm, loc, pop).collect()}
    assert got == {("A", None): ("RDT", 7.0), ("A", 1): ("RDT", 8.0), ("B", 1): (None, None)}


PATIENTS = """study_id STRING, age_years INT, hb_level DOUBLE, deep_breathing BOOLEAN, bcs INT, apvu STRING, unconscious BOOLEAN,
    pallor STRING, transfusion BOOLEAN, intercostal_recession BOOLEAN"""


@pytest.fixture(scope="module")
def patients(spark):
    rows = [
        ("s1", 0, 4.0, False, 5, "A", False, "Severe", True, None),
        ("s1", 0, None, None, None, None, None, "Severe", True, True),
        ("s1", 1, 8.0, True, 1, "A", False, "Mild", False, True),
        ("s2", 1, None, None, None, None, None, None, None, None),
        ("s2", None, 9.0, False, 5, "A", False, None, False, None),
    ]
    return spark.createDataFrame(rows, PATIENTS)


@pytest.fixture(scope="module")
def population(spark):
    return spark.createDataFrame([("s1", 1000.0), ("s2", None)], "study_id string, py double")


def test_case_counts(patients, population):
    sma = {r.study_id: (r.n, r.py, r.rate) for r in burden.phenotype_counts(patients, "sma", population).collect()}
    assert sma == {"s1": (1, 1000.0, 1.0), "s2": (0, None, None)}
    cm = {r.study_id: r.n for r in burden.phenotype_counts(patients, "cm", population).collect()}
    assert cm == {"s1": 1, "s2": 0}


def test_imputed_cases(patients, population):
    got = {r.study_id: (r.n, r.unknown, r.estimated) for r in burden.imputed_admissions(patients, "sma", population).collect()}
    # class 4: one known positive of one, so (1 + 1) / (2 + 1)
    assert got["s1"] == (1, 1, pytest.approx(1 + 2 / 3))
    assert got["s2"] == (0, 0, 0.0)


def test_composite_expectation(patients):
    got = {r.study_id: (r.observed, r.patients, r.estimated) for r in burden.composite_imputed(patients).collect()}
    unknown_s1 = 1 - (1 - 2 / 3) * (1 - 2 / 3)
    unknown_s2 = 1 - (1 - 1 / 4) * (1 - 1 / 4)  # class 1: two known negatives; recession class 1: two known negatives
    assert got["s1"] == (2, 3, pytest.approx(2 + unknown_s1))
    assert got["s2"] == (0, 2, pytest.approx(unknown_s2))


def test_age_rates_count_before_joining(spark, patients):
    pop = spark.createDataFrame([("s1", 0, 100.0), ("s1", 1, 50.0), ("s2", 1, 50.0)], "study_id string, age_years int, n_age double")
    pr = spark.createDataFrame([("s1", 0.12), ("s2", 0.14)], "study_id string, pr double")
    got = {(r.age_years, r.band): (r.n, r.py) for r in burden.band_rates(patients, pop, pr, 0.05).collect()}
    assert got == {(0, 2): (1, 100.0), (1, 2): (1, 50.0), (None, 2): (0, None)}


@pytest.fixture(scope="module")
def draws(spark):
    rng = np.random.default_rng(5)
    n = 240
    columns = {
        "chain": [int(i % 3) for i in range(n)], "iteration": list(range(n)),
        "intercept": rng.normal(-6, 0.1, n), "beta1": rng.normal(1, 0.2, n), "beta2": rng.normal(1, 0.1, n),
        "r": rng.normal(5, 0.1, n), "alpha_parm[1]": rng.normal(-6, 0.1, n), "alpha_parm[2]": rng.normal(1, 0.1, n),
        "betas[1]": rng.normal(1, 0.1, n), "betas[2]": rng.normal(-1, 0.1, n), "sigma": rng.normal(2, 0.05, n),
        "PR_crit": rng.normal(0.25, 0.02, n), "PR_corrected[1]": rng.uniform(0.1, 0.5, n), "PR_corrected[2]": rng.uniform(0.1, 0.5, n),
        "estimated_admissions[1]": rng.uniform(50, 60, n), "estimated_admissions[2]": rng.uniform(50, 60, n),
        "RE[1]": rng.normal(0, 1, n), "RE[2]": rng.normal(0, 1, n),
    }
    rows = [tuple(v.item() if hasattr(v, "item") else v for v in row) for row in zip(*columns.values())]
    kinds = ", ".join(f"`{c}` {'int' if c == 'chain' else 'bigint' if c == 'iteration' else 'double'}" for c in columns)
    return spark.createDataFrame(rows, kinds).repartition(3).cache()


def profile_rows(spark):
    return spark.createDataFrame([(0.1, 1.0, -1.0, 2.0, 0.25), (0.5, 1.0, -1.0, 2.0, 0.25)], "pr double, a2 double, b2 double, sigma double, crit double")


@pytest.mark.parametrize("rule", ["right", "trapezoid"])
def test_age_shares_sum_to_one(spark, rule):
    ages = posterior.monthly_ages()
    profile = posterior.age_profile(profile_rows(spark), ages, rule=rule)
    sums = {r.pr: r.s for r in profile.groupBy("pr").agg(F.sum("share").alias("s")).collect()}
    assert sums == {0.1: pytest.approx(1.0), 0.5: pytest.approx(1.0)}
    flat = profile.where("pr = 0.1").agg(F.min("share"), F.max("share")).first()
    assert flat[0] == flat[1] == pytest.approx(1 / 120)


def test_age_shares_follow_the_density(spark):
    ages = posterior.site_ages()
    got = [r.share for r in posterior.age_profile(profile_rows(spark), ages).where("pr = 0.5").orderBy("band").collect()]
    mode = math.exp(1 - 0.5)
    rate = (mode + math.sqrt(mode**2 + 16)) / 8
    shape = 1 + mode * rate
    f = [math.exp(shape * math.log(rate) - math.lgamma(shape) + (shape - 1) * math.log(b) - rate * b) * (b - a) for a, b in zip(ages, ages[1:])]
    assert got == pytest.approx([v / sum(f) for v in f], rel=1e-10)
    flat = posterior.age_profile(profile_rows(spark), ages, below="flat").where("pr = 0.1").first()
    assert flat.share == 0.1


def test_surface_of_chosen_steps_equals_whole(draws):
    ages = posterior.site_ages()
    whole = {(r.pr_index, r.band): r.median for r in posterior.age_surface(draws, 5, 10, ages).collect()}
    part = {(r.pr_index, r.band): r.median for r in posterior.age_surface(draws, 5, 10, ages, chosen=[1, 4]).collect()}
    assert len(whole) == 50 and part == {k: v for k, v in whole.items() if k[0] in (1, 4)}


def test_diagnostics_do_not_depend_on_blocks(draws):
    whole = {r.parameter: r for r in posterior.chain_diagnostics(draws).collect()}
    cut = {r.parameter: r for r in posterior.chain_diagnostics(draws, block_rows=17).collect()}
    pdf = draws.toPandas().sort_values("iteration")
    for name, row in whole.items():
        assert list(row)[1:] == pytest.approx(list(cut[name])[1:], rel=1e-9)
        x = pdf[name]
        assert (row["mean"], row.sd) == (pytest.approx(x.mean()), pytest.approx(x.std()))
        acf = [c[name].autocorr(10) for _, c in pdf.groupby("chain")]
        assert row.acf_10 == pytest.approx(np.mean(acf))
        chains = [c[name] for _, c in pdf.groupby("chain")]
        w, b = np.mean([c.var() for c in chains]), 80 * np.var([c.mean() for c in chains], ddof=1)
        assert row.r_hat == pytest.approx(math.sqrt((79 / 80 * w + b / 80) / w))


def test_summaries_ignore_unmonitored_families(draws):
    assert posterior.indexed(draws, "rho_SMA") == {}
    names = {r.parameter for r in posterior.summarise(draws).collect()}
    assert "PR_corrected[2]" in names and "chain" not in names


def test_curve_is_the_rate_at_each_step(draws):
    rows = {r.step: r for r in posterior.fitted_curve(draws, "linear", 4, 0.6, "x").collect()}
    pdf = draws.toPandas()
    assert rows[3].pr == pytest.approx(60)
    assert rows[3].median == pytest.approx(math.exp(np.median(pdf.intercept + 0.6 * pdf.beta1)) * 1000)
    flat = posterior.fitted_curve(draws, "intercept", 4, 0.6, "x").collect()
    assert len(flat) == 4 and len({r.median for r in flat}) == 1


def test_no_form_lists_are_wrong(draws):
    with pytest.raises(KeyError):
        posterior.fitted_curve(draws, "cubic", 4, 0.6, "x")


def test_poisson_fit_equals_the_library(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rng = np.random.default_rng(11)
    pr, py = rng.uniform(0, 0.6, 60), rng.uniform(500, 3000, 60)
    n = rng.poisson(py * np.exp(-5 + 2 * pr))
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(n, py, pr)], "n double, py double, pr double")
    mine = regression.fit_rate(df).first()
    ready = VectorAssembler(inputCols=["pr"], outputCol="x").transform(df.withColumn("offset", F.log("py")))
    model = GeneralizedLinearRegression(family="poisson", featuresCol="x", labelCol="n", offsetCol="offset", tol=1e-12).fit(ready)
    assert (mine.intercept, mine.beta1) == (pytest.approx(model.intercept, abs=1e-8), pytest.approx(model.coefficients[0], abs=1e-8))
    nb = regression.fit_rate(df, "negbin").first()
    assert nb.r > 0 and nb.beta1 == pytest.approx(2, abs=0.5)


def test_scans_read_only_what_is_needed(spark):
    from burdenflow.catalogue.queries import REGISTRY

    plan = REGISTRY["case_counts_sma"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    read = [set(re.findall(r"(l_\w+):", s)) for s in re.findall(r"ReadSchema: struct<([^>]*)", plan) if "l_orderkey" in s]
    assert read == [{"l_orderkey", "l_linenumber", "l_quantity"}]


def test_rate_without_cases_or_contrast(spark):
    none = spark.createDataFrame([(0, 10.0, 0.1), (0, 20.0, 0.4)], "n long, py double, pr double")
    row = regression.fit_rate(none).first()
    assert (row.intercept, row.beta1, row.log_lik, row.converged, row.studies) == (None, None, None, False, 2)
    flat = spark.createDataFrame([(3, 10.0, 0.2), (5, 20.0, 0.2)], "n long, py double, pr double")
    assert regression.fit_rate(flat).first().beta1 is None
    assert regression.fit_rate(flat, "negbin", "logistic").first().beta1 is None
    level = regression.fit_rate(flat, "poisson", "intercept").first()
    assert level.converged and abs(level.intercept - np.log(8 / 30)) < 1e-9
    assert regression.fit_rate(none.limit(0)).first().studies == 0


def test_rate_says_when_it_has_not_settled(spark):
    df = spark.createDataFrame([(3, 10.0, 0.1), (30, 20.0, 0.4), (90, 20.0, 0.7)], "n long, py double, pr double")
    early, late = regression.fit_rate(df, most=1).first(), regression.fit_rate(df).first()
    assert (early.converged, early.steps) == (False, 1) and late.converged and late.steps > 1


def test_shape_is_refined_between_the_grid(spark):
    rows = [(float(1e6 * np.exp(-3 + 2 / (1 + np.exp(-3.33 * x)))), 1e6, float(x)) for x in np.linspace(0.02, 0.9, 25)]
    df = spark.createDataFrame(rows, "n double, py double, pr double")
    assert abs(regression.fit_rate(df, "poisson", "logistic").first().beta2 - 3.33) < 0.01


def test_study_numbers_come_from_one_dimension(spark):
    """A study without a survey leaves the numbers of the others as they are."""
    studies = spark.createDataFrame([(1, "A 2001"), (2, "B 2002"), (3, "C 2003")], "study_number long, study_id string")
    raw = spark.createDataFrame(
        [("A, Kenya", "2001", 1.0, 5.0, 10, 2), ("C, Kenya", "2003", 1.0, 5.0, 10, 3)],
        "site string, period string, min_age double, max_age double, number long, positives long",
    )
    methods = spark.createDataFrame([("A", "2001", "RDT"), ("C", "2003", "RDT")], "site string, period string, detection_method string")
    got = {r.study_id: r.study_number for r in cleaning.format_surveys(raw, methods, studies).collect()}
    assert got == {"A 2001": 1, "C 2003": 3}


def test_every_study_takes_its_index(spark):
    rows = spark.createDataFrame([(i, 10.0 * i) for i in (1, 2, 3)], "idx int, v double")
    studies = spark.range(1, 8).withColumnRenamed("id", "study_number")
    got = {r.study_number: r.v for r in posterior.at_studies(rows, studies, 3).collect()}
    assert got == {1: 10.0, 2: 20.0, 3: 30.0, 4: 10.0, 5: 20.0, 6: 30.0, 7: 10.0}


def drawn_by_hand(rows, keys, draws, seed):
    """Composite totals per group and draw, patient by patient, from rates found by halving."""
    def uniform(*key):
        digest = hashlib.md5(":".join(map(str, key)).encode()).hexdigest()
        return (int(digest[:12], 16) + 0.5) / 2**48

    def quantile(p, a, b):
        low, high, n = 0.0, 1.0, a + b - 1
        for _ in range(60):
            x = (low + high) / 2
            low, high = (x, high) if sum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1)) < p else (low, x)
        return x

    rates = {}
    for phenotype in ("sma", "rd"):
        for k in {r[f"class_{phenotype}"] for r in rows}:
            known = [r[phenotype] for r in rows if r[f"class_{phenotype}"] == k and r[phenotype] is not None]
            for i in range(1, draws + 1):
                rates[phenotype, k, i] = quantile(uniform(seed, phenotype, k, i), sum(known) + 1, len(known) - sum(known) + 1)
    out = {}
    for r in rows:
        total = out.setdefault(tuple(r[k] for k in keys), np.zeros(draws))
        for i in range(1, draws + 1):
            share = [float(r[p]) if r[p] is not None else rates[p, r[f"class_{p}"], i] for p in ("sma", "rd")]
            total[i - 1] += 1 - (1 - share[0]) * (1 - share[1]) * (1 - float(r["cm"]))
    return out


@pytest.mark.parametrize("keys", [["study_id"], ["study_id", "age_years"]])
def test_composite_draws_match_patients_one_by_one(spark, keys):
    rng = np.random.default_rng(3)
    pick = lambda *values: values[rng.integers(len(values))]
    names = "study_id age_years hb_level pallor transfusion deep_breathing intercostal_recession apvu unconscious bcs"
    rows = [
        (pick("a", "b", "c"), pick(0, 1, None), pick(3.0, 9.0, None), pick("Severe", "None", None), pick(True, False, None),
         pick(True, False, None), pick(True, False, None), pick("A", "U", None), pick(False, None), pick(5, 1, None, None))
        for _ in range(300)
    ]
    # a class without any known status, and a study without any unknown one
    rows = [r if r[4] is not True or r[3] != "Severe" else (*r[:2], None, *r[3:]) for r in rows]
    rows += [("d", 1, 9.0, None, None, False, None, "A", False, 5)] * 4
    schema = "study_id string, age_years int, hb_level double, pallor string, transfusion boolean, deep_breathing boolean, "
    schema += "intercostal_recession boolean, apvu string, unconscious boolean, bcs int"
    assert [c.split()[0] for c in schema.split(", ")] == names.split()
    patients = spark.createDataFrame(rows, schema)
    flagged = burden.classed(clinical.case_flags(patients, cm_default=False)).collect()
    want = drawn_by_hand(flagged, keys, 12, 5)
    got = burden.composite_imputed_draws(patients, keys, draws=12, seed=5).collect()
    assert {tuple(r[k] for k in keys) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        totals = want[tuple(r[k] for k in keys)]
        bounds = [r.estimated_q025, r.estimated_median, r.estimated_q975]
        assert bounds == pytest.approx(list(np.quantile(totals, [0.025, 0.5, 0.975])), abs=1e-8)
    assert sum(r.patients for r in got) == len(rows)
    empty = burden.composite_imputed_draws(patients.limit(0), keys, draws=12)
    assert empty.count() == 0


def test_stored_draws_meet_studies_without_a_shuffle(spark):
    rows = [(c, i, float(i), *[float(10 * i + k) for k in range(6)]) for c in (1, 2) for i in range(40)]
    names = [f"{family}[{k}]" for family in ("PR", "RE") for k in (1, 2, 3)]
    draws = spark.createDataFrame(rows, "chain int, iteration int, r double, " + ", ".join(f"`{n}` double" for n in names))
    families = {"PR": "pr", "RE": "re"}
    made = posterior.draw_rows(draws, families, ["r"])
    want = posterior.site_draws(draws, families, keep=[*posterior.IDS, "r"])
    columns = ["idx", "chain", "iteration", "r", "pr", "re"]
    assert sorted(made.select(columns).collect()) == sorted(want.select(columns).collect())
    store = store_bucketed(made, "draws_test", ["idx"], 8)
    studies = spark.createDataFrame([(n, n * 2) for n in range(1, 8)], "study_number int, n int")
    met = posterior.at_stored_studies(store, studies, 3)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan and plan.count("Exchange") == 1
    got = sorted((r.study_number, r.chain, r.iteration, r.pr) for r in met.collect())
    assert got == sorted((n, c, i, float(10 * i + (n - 1) % 3)) for n in range(1, 8) for c in (1, 2) for i in range(40))


def test_admissions_are_not_shuffled_to_small_study_tables(spark):
    adm = spark.range(1000).selectExpr("CAST(id % 3 AS STRING) AS site", "'2006-07' AS period", "CAST(id % 4 AS INT) AS age_years", "id AS x")
    # by its estimate this is no small table
    many = spark.range(3_000_000).selectExpr("CAST(id % 2 AS STRING) AS site", "'2006-07' AS period", "CAST(id % 5 AS INT) AS age_years")
    loc = many.groupBy("site", "period").agg(F.count("*").alias("n_examined"))
    pop = many.groupBy("site", "period", "age_years").agg(F.count("*").alias("n_age"))
    complete = cleaning.build_complete(adm, loc, pop)
    plan = complete._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("BroadcastHashJoin") == 2
    known = complete.groupBy("site").agg(F.count("*"), F.max("n_examined"), F.max("n_age")).orderBy("site").collect()
    assert [tuple(r) for r in known] == [("0", 334, 1_500_000, 300_000), ("1", 333, 1_500_000, 300_000), ("2", 333, None, None)]


def test_the_stored_analysis_table_is_compressed(spark, tmp_path):
    tables = {
        "region": "0 AS r_regionkey, 'R' AS r_name FROM range(1)",
        "nation": "CAST(id AS INT) AS n_nationkey, concat('N', id) AS n_name, 0 AS n_regionkey FROM range(3)",
        "customer": "id AS c_custkey, CAST(id % 3 AS INT) AS c_nationkey FROM range(9)",
        "orders": "id AS o_orderkey, id % 9 AS o_custkey, DATE '1995-03-01' AS o_orderdate, 'P' AS o_orderstatus FROM range(40)",
        "lineitem": """id % 40 AS l_orderkey, id AS l_partkey, id AS l_suppkey, CAST(id % 7 AS INT) AS l_linenumber,
            CAST(id % 50 AS DOUBLE) AS l_quantity, 0.05D AS l_discount, 0.02D AS l_tax, 'A' AS l_returnflag, 'F' AS l_linestatus FROM range(200)""",
    }
    for name, sql in tables.items():
        spark.sql(f"SELECT {sql}").write.parquet(f"{tmp_path}/{name}.parquet")
    stored = REGISTRY["combined_roundtrip"](spark, str(tmp_path))
    assert all(name.endswith(".csv.gz") for name in stored.inputFiles())
    joined = REGISTRY["combined_left_joins"](spark, str(tmp_path)).select(*stored.columns)
    assert sorted(map(str, stored.collect())) == sorted(map(str, joined.collect())) and stored.count() == 200
