"""Named queries: each takes a session and the folder of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from burdenflow.functions import clinical as c
from burdenflow.functions.text import parameter_index
from burdenflow.operators import groups as g
from burdenflow.operators.joins import lookup, natural_join
from burdenflow.operators.ordering import hdi, quantiles
from burdenflow.operators.shaping import above_threshold, append, filter_parameter, select_renamed, single
from burdenflow.plans import burden, cleaning, posterior, prevalence, regression
from burdenflow.sources import schemas
from burdenflow.sources.tables import new_path, read_parts, read_sheet, read_table, replace_partitions, store_bucketed, write_table
from burdenflow.sources.testbed import EVENT_INDEXES, PERIOD_REPAIR, SITE_INDEXES, Testbed
from burdenflow.sources.weights import age_weights

DIGITS = 6
# what lies half-way between two shown values goes up on both sides of a check
TIE = 1e-9
# measured, not computed: equal to the last digit on both sides
EXACT = """age_months temperature fever_days fits_per_24h hb_level latitude longitude hbas hospital_min_dist
    hospital_max_dist itn rainfall altitude pr_c n_age total_population""".split()
BAND_WIDTH = 0.05
PHENOTYPES = ("a. anaemia", "b. respiratory distress", "c. cerebral malaria")
SAMPLE = 200
CLASS_DRAWS = 60

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


class Case(Testbed):
    """Domain tables in the shapes that several queries start from."""

    def cleaned(self) -> DataFrame:
        return cleaning.clean_admissions(self.admissions(), PERIOD_REPAIR)

    def patients(self) -> DataFrame:
        return cleaning.study_rows(self.cleaned())

    def population(self) -> DataFrame:
        return cleaning.age_population(*self.population_parts())

    def study_years(self) -> DataFrame:
        return cleaning.study_populations(cleaning.read_population(*self.population_parts()))

    def age_years(self) -> DataFrame:
        ages = cleaning.study_rows(cleaning.read_population(*self.population_parts()))
        return ages.select("study_id", "age_years", "n_age")

    def places(self) -> DataFrame:
        return cleaning.format_locations(self.locations_raw())

    def methods(self) -> DataFrame:
        return cleaning.detection_methods(self.locations_raw())

    def survey_rows(self) -> DataFrame:
        return cleaning.survey_rows(self.surveys(), self.methods())

    def formatted_surveys(self) -> DataFrame:
        return cleaning.format_surveys(self.surveys(), self.methods(), self.studies())

    def complete(self) -> DataFrame:
        return cleaning.build_complete(self.cleaned(), self.places(), self.population())

    def studies(self) -> DataFrame:
        return cleaning.study_dim(self.patients())

    def phenotype_draws(self) -> DataFrame:
        """The draws dealt out to three phenotypes, by iteration."""
        names = F.array(*map(F.lit, PHENOTYPES))
        return self.draws_wide().withColumn("curve", F.get(names, F.pmod("iteration", F.lit(len(PHENOTYPES))).cast("int")))

    def study_cases(self, phenotype: str = "sma") -> DataFrame:
        """Cases of every study that is counted, with its number in the one study dimension."""
        counts = burden.phenotype_counts(self.patients(), phenotype, self.study_years())
        numbers = cleaning.numbers_of(self.studies())
        return natural_join(counts, numbers, "inner", on=["study_id"], null_safe=False)


def shown(df: DataFrame) -> DataFrame:
    """Computed doubles to six places, whole numbers as BIGINT."""
    out = []
    for name, kind in df.dtypes:
        value = F.col(f"`{name}`")
        if kind == "double" and name not in EXACT:
            value = F.round(value + TIE, DIGITS)
        elif kind in ("int", "bigint"):
            value = value.cast("bigint")
        out.append(value.alias(name))
    return df.select(*out)


def query(build: Callable[[Case], DataFrame]) -> Callable[[Case], DataFrame]:
    REGISTRY[build.__name__] = lambda spark, folder: shown(build(Case(spark, folder)))
    return build


# --- cleaning -------------------------------------------------------------------------


@query
def clean_admissions(t: Case) -> DataFrame:
    return t.cleaned()


@query
def phenotype_flags_raw(t: Case) -> DataFrame:
    raw = c.raw_flags(t.admissions()).select(
        "bcs", "apvu", "unconscious", "deep_breathing", "sma", "cerebral_raw", "anemia_raw", "respiratory_raw"
    )
    return raw


@query
def phenotype_flags(t: Case) -> DataFrame:
    flagged = c.case_flags(burden.classed(t.patients()), cm_default=False)
    return flagged.select("study_id", "sma", "rd", "cm", "composite", "composite_alt", "class_sma", "class_rd")


@query
def age_population_union(t: Case) -> DataFrame:
    return t.population()


@query
def location_features(t: Case) -> DataFrame:
    return t.places()


@query
def combined_left_joins(t: Case) -> DataFrame:
    return t.complete()


@query
def study_dimension(t: Case) -> DataFrame:
    return t.studies()


@query
def survey_format(t: Case) -> DataFrame:
    return t.formatted_surveys()


@query
def survey_group_mean(t: Case) -> DataFrame:
    return prevalence.survey_means(t.formatted_surveys())


# --- counts and classes ---------------------------------------------------------------


def _case_counts(phenotype: str) -> Callable[[Case], DataFrame]:
    def build(t: Case) -> DataFrame:
        return burden.phenotype_counts(t.patients(), phenotype, t.study_years())

    build.__name__ = f"case_counts_{phenotype}"
    return build


for _phenotype in ("sma", "rd", "cm", "composite"):
    query(_case_counts(_phenotype))


@query
def evidence_class_counts(t: Case) -> DataFrame:
    return burden.evidence_counts(burden.status_counts(t.patients()))


@query
def undiagnosed_pivot(t: Case) -> DataFrame:
    return burden.undiagnosed(t.patients(), "sma")


@query
def undiagnosed_pivot_rd(t: Case) -> DataFrame:
    return burden.undiagnosed(t.patients(), "rd")


@query
def class_positivity(t: Case) -> DataFrame:
    return burden.class_positivity(burden.evidence_counts(burden.status_counts(t.patients())), ["phenotype", "class"])


@query
def imputed_admissions(t: Case) -> DataFrame:
    return burden.imputed_admissions(t.patients(), "sma", t.study_years())


@query
def imputed_admissions_rd(t: Case) -> DataFrame:
    return burden.imputed_admissions(t.patients(), "rd", t.study_years())


@query
def composite_imputed(t: Case) -> DataFrame:
    return burden.composite_imputed(t.patients())


@query
def composite_imputed_by_age(t: Case) -> DataFrame:
    return c.age_bands(burden.composite_imputed(t.patients(), ["study_id", "age_years"]))


@query
def composite_imputed_draws(t: Case) -> DataFrame:
    return whole_draws(burden.composite_imputed_draws(t.patients(), draws=CLASS_DRAWS))


@query
def composite_imputed_draws_by_age(t: Case) -> DataFrame:
    return whole_draws(burden.composite_imputed_draws(t.patients(), ["study_id", "age_years"], draws=CLASS_DRAWS))


def whole_draws(df: DataFrame) -> DataFrame:
    """Expected patients to three places: both sides find the bounds by iteration."""
    return df.withColumns({name: F.round(F.col(name) + TIE, 3) for name in df.columns if name.startswith("estimated_")})


@query
def row_ranges(t: Case) -> DataFrame:
    return g.row_ranges(t.patients(), ["study_id"])


@query
def age_band_rates(t: Case) -> DataFrame:
    means = prevalence.survey_means(t.survey_rows())
    return burden.band_rates(t.patients(), t.age_years(), means, BAND_WIDTH)


@query
def site_age_steps(t: Case) -> DataFrame:
    """Composite cases by study and age, with the next observed age of the study."""
    cases = burden.site_age_cases(t.patients(), t.age_years()).where(F.col("age_years").isNotNull())
    return g.next_value(cases, ["study_id"], "age_years", "age_years", "age_plus")


# --- prevalence -----------------------------------------------------------------------


@query
def age_curve(t: Case) -> DataFrame:
    """Age curve of infection at all ages beside the admissions of each year of age."""
    year = F.col("age_years") + 1
    admitted = t.cleaned().where(F.col("age_years").isNotNull()).groupBy(year.alias("age")).agg(
        F.count(F.lit(1)).alias("patients")
    )
    curve = lookup(age_weights(t.spark, "midpoint"), admitted, {"age": "age"})
    return curve.withColumn("patients", F.coalesce("patients", F.lit(0)))


def _standardised(t: Case, path: str) -> DataFrame:
    means = prevalence.survey_means(t.formatted_surveys())
    near = prevalence.standardise_prevalence(means, 2, 9, path=path, keys=["study_id"])
    wide = prevalence.constant_ratio(1, 85, "midpoint")
    return near.withColumn("pr_all", F.col("x") * wide)


@query
def standardise_prevalence(t: Case) -> DataFrame:
    return _standardised(t, "range")


@query
def standardise_prevalence_prefix(t: Case) -> DataFrame:
    return _standardised(t, "prefix")


@query
def corrected_prevalence(t: Case) -> DataFrame:
    surveys = prevalence.point_prevalence(t.survey_rows())
    return surveys.select("study_id", "detection_method", "k", "p_prime", "pr_survey", "pr_mic", "pr_corrected")


@query
def drawn_prevalence(t: Case) -> DataFrame:
    draws = t.draws_wide()
    sites = posterior.site_draws(draws, {"PR_corrected": "p_prime"})
    surveys = t.formatted_surveys().select("study_number", "min_age", "max_age", "detection_method")
    return prevalence.drawn_prevalence(posterior.at_studies(sites, surveys, len(SITE_INDEXES)))


# --- draws ----------------------------------------------------------------------------


@query
def posterior_summary(t: Case) -> DataFrame:
    return posterior.summarise(t.draws_wide())


@query
def posterior_summary_by_model(t: Case) -> DataFrame:
    """Draws of all models and chains, from both stores, summarised by model and parameter."""
    wide = t.draws_wide()
    parameters = posterior.to_long(wide, posterior.IDS).withColumn("model", F.lit("joint"))
    return posterior.summarise_models(posterior.concat_chains(t.draws_long().drop("idx"), parameters))


@query
def posterior_quantiles_long(t: Case) -> DataFrame:
    return quantiles(t.draws_long(), ["parameter"], "value", posterior.BANDS)


@query
def posterior_hdi(t: Case) -> DataFrame:
    return hdi(t.draws_long(), ["parameter"], "value", 0.95)


@query
def composite_summary(t: Case) -> DataFrame:
    return posterior.summarise_dense(t.draws_wide())


@query
def fold_change(t: Case) -> DataFrame:
    return posterior.fold_change(t.draws_wide())


@query
def sampled_site_draws(t: Case) -> DataFrame:
    return posterior.sampled_site_draws(t.draws_wide(), SAMPLE)


@query
def parameter_families(t: Case) -> DataFrame:
    """Parameters of some families by the index in their name."""
    kept = filter_parameter(t.draws_long(), "^(click|view|error)", exclude="error")
    return kept.groupBy("parameter", parameter_index(F.col("parameter")).alias("number")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")
    )


@query
def chain_diagnostics(t: Case) -> DataFrame:
    return posterior.chain_diagnostics(t.draws_wide())


@query
def sampled_draws(t: Case) -> DataFrame:
    return posterior.sampled_parameters(t.draws_wide(), SAMPLE, "beta|alpha_parm|sigma|PR_crit")


def _curves(t: Case, *places: int) -> dict[int, DataFrame]:
    draws = t.draws_wide()
    upper = posterior.upper_prevalence(draws, t.studies())
    forms = {
        1: ("logistic", 500, PHENOTYPES[0]), 2: ("linear", 100, PHENOTYPES[1]), 3: ("intercept", 100, PHENOTYPES[2]),
    }
    return {place: posterior.fitted_curve(draws, forms[place][0], forms[place][1], upper, forms[place][2]) for place in places}


@query
def curve_linear(t: Case) -> DataFrame:
    return posterior.fitted_curve(t.draws_wide(), "linear", 1000, 0.75, "composite")


@query
def curve_logistic(t: Case) -> DataFrame:
    return _curves(t, 1)[1]


@query
def curve_constant(t: Case) -> DataFrame:
    return _curves(t, 3)[3]


@query
def curves_union(t: Case) -> DataFrame:
    return posterior.curves_union(_curves(t, 1, 2, 3))


def _point_sites(t: Case) -> DataFrame:
    crude = prevalence.point_prevalence(t.survey_rows())
    return posterior.point_sites(t.studies(), t.study_years(), t.methods(), crude)


@query
def curve_points(t: Case) -> DataFrame:
    """Points beside the three curves, each from the draws of its phenotype; cerebral cases are not imputed."""
    summary = posterior.summarise_by(t.phenotype_draws(), "curve")
    points = posterior.study_points(summary, _point_sites(t), by=["curve"])
    cerebral = burden.phenotype_counts(t.patients(), "cm", t.study_years())
    return posterior.with_observed_rates(points, cerebral, PHENOTYPES[2])


@query
def curve_points_composite(t: Case) -> DataFrame:
    """Points of the composite with densest intervals."""
    points = posterior.study_points(posterior.summarise_dense(t.draws_wide()), _point_sites(t), posterior.DENSE)
    return points.withColumn("curve", F.lit("composite"))


@query
def modal_age(t: Case) -> DataFrame:
    """Modal age where the prevalence reaches the threshold."""
    draws = t.draws_wide()
    cut = single(posterior.threshold_summary(draws), F.max("cut_median"))
    return above_threshold(posterior.modal_age(draws), "pr", cut, 0.993)


@query
def threshold_summary(t: Case) -> DataFrame:
    return posterior.threshold_summary(t.draws_wide())


@query
def age_surface(t: Case) -> DataFrame:
    return posterior.age_surface(t.draws_wide())


@query
def age_profiles(t: Case) -> DataFrame:
    """Age profiles at four prevalences, labelled."""
    chosen = posterior.age_surface(t.draws_wide(), chosen=[0, 25, 50, 75])
    label = F.when(F.col("pr_index") == 0, F.lit("<1%")).otherwise(F.concat(F.col("pr_index").cast("string"), F.lit("%")))
    return chosen.withColumn("label", label)


@query
def site_age_fit(t: Case) -> DataFrame:
    fitted = posterior.site_age_fit(t.draws_wide(), t.studies())
    return lookup(fitted, t.studies().select("study_number", "study_id"), {"study_number": "study_number"})


@query
def site_age_observed(t: Case) -> DataFrame:
    """Every study and age takes the draws of one of the ten indexes of the events."""
    cases = burden.site_age_cases(t.patients(), t.age_years())
    draws = t.draws_long().withColumn("idx", F.col("idx") + 1)
    fitted = posterior.site_age_fit(t.draws_wide(), t.studies())
    return posterior.site_age_observed(cases, draws, fitted, t.studies(), EVENT_INDEXES)


# --- models ---------------------------------------------------------------------------


@query
def expected_rates(t: Case) -> DataFrame:
    return posterior.expected_rates(t.draws_wide(), t.study_cases())


@query
def model_scores(t: Case) -> DataFrame:
    return posterior.model_scores(t.draws_wide(), t.study_cases(), "sma")


def _stored_studies(t: Case) -> DataFrame:
    """Draws of every study out of a store that is bucketed by their index."""
    draws, families = t.draws_wide(), posterior.SCORE_FAMILIES
    rows = posterior.draw_rows(draws, families, posterior.SCORE_PARAMETERS)
    store = store_bucketed(rows, "draws_by_index", ["idx"], int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    indexes = len(posterior.shared_indexes(draws, list(families)))
    return posterior.at_stored_studies(store, t.study_cases().select("study_number", "n", "py"), indexes)


@query
def expected_rates_stored(t: Case) -> DataFrame:
    return posterior.rates_of(_stored_studies(t))


@query
def model_scores_stored(t: Case) -> DataFrame:
    return posterior.scores_of(_stored_studies(t), "sma")


@query
def model_scores_rd(t: Case) -> DataFrame:
    return posterior.model_scores(t.draws_wide(), t.study_cases("rd"), "rd")


@query
def model_scores_composite(t: Case) -> DataFrame:
    return posterior.model_scores(t.draws_wide(), t.study_cases("composite"), "composite")


@query
def model_scores_cm(t: Case) -> DataFrame:
    return posterior.model_scores(t.draws_wide(), t.study_cases("cm"), "cm", corrected=False)


def _regression(t: Case, family: str, form: str, phenotype: str = "sma") -> DataFrame:
    surveys = prevalence.point_prevalence(t.survey_rows()).select("study_id", F.col("pr_corrected").alias("pr"))
    counts = burden.phenotype_counts(t.patients(), phenotype, t.study_years())
    rows = natural_join(counts, surveys, "inner", on=["study_id"], null_safe=False)
    return regression.fit_rate(rows, family, form).drop("steps")


@query
def rate_regression(t: Case) -> DataFrame:
    return _regression(t, "poisson", "linear")


@query
def rate_regression_nb(t: Case) -> DataFrame:
    return _regression(t, "negbin", "linear")


@query
def rate_regression_logistic(t: Case) -> DataFrame:
    return _regression(t, "poisson", "logistic")


@query
def rate_regression_nb_logistic(t: Case) -> DataFrame:
    return _regression(t, "negbin", "logistic")


@query
def rate_regression_intercept(t: Case) -> DataFrame:
    return _regression(t, "negbin", "intercept")


@query
def rate_regression_rd(t: Case) -> DataFrame:
    return _regression(t, "negbin", "linear", "rd")


@query
def rate_regression_cm(t: Case) -> DataFrame:
    return _regression(t, "negbin", "linear", "cm")


@query
def rate_regression_composite(t: Case) -> DataFrame:
    return _regression(t, "negbin", "linear", "composite")


# --- stores ---------------------------------------------------------------------------


@query
def combined_roundtrip(t: Case) -> DataFrame:
    path = new_path(t.spark, "complete")
    ordered = t.complete().select(*_names(schemas.COMPLETE))
    # a row is some 250 characters, most of which repeat the features of its study
    write_table(ordered, path, "csv", compression="gzip")
    return read_table(t.spark, path, schemas.COMPLETE, "csv")


@query
def sheet_roundtrip(t: Case) -> DataFrame:
    """Raw admissions written as a sheet under its own headers and read back by them."""
    headers = schemas.ADMISSION_HEADERS
    sheet = select_renamed(t.admissions(), {name: header for header, name in headers.items()})
    path = write_table(sheet, new_path(t.spark, "sheet"), "csv")
    return read_sheet(t.spark, path, headers, schemas.ADMISSIONS_RAW)


@query
def population_parts_roundtrip(t: Case) -> DataFrame:
    """Age populations written as one part for each site and period and read back with the part's name."""
    parts = append(*t.population_parts())
    path = write_table(parts, new_path(t.spark, "parts"), "csv", partition_by=["file_id"])
    return read_parts(t.spark, f"{path}/*/*.csv", schemas.POPULATION_PART, by_folder=True)


@query
def survey_store_roundtrip(t: Case) -> DataFrame:
    path = write_table(t.formatted_surveys(), new_path(t.spark, "surveys"))
    return read_table(t.spark, path, schemas.SURVEYS)


@query
def draw_store_roundtrip(t: Case) -> DataFrame:
    """Draws stored by model; one model read back, the other folders never opened."""
    path = write_table(t.draws_long(), new_path(t.spark, "draws"), partition_by=["model"])
    return read_table(t.spark, path, schemas.DRAWS_LONG).where(F.col("model") == "purchase")


@query
def draw_store_rerun(t: Case) -> DataFrame:
    """Two models stored, one of them run again with fewer chains: its draws replaced, the other's folder untouched."""
    draws = t.draws_long().where(F.col("model").isin("purchase", "view"))
    path = write_table(draws, new_path(t.spark, "draws"), partition_by=["model"])
    again = t.draws_long().where((F.col("model") == "purchase") & (F.col("chain") == 1)).withColumn("value", F.col("value") * 2)
    replace_partitions(again, path, ["model"])
    return read_table(t.spark, path, schemas.DRAWS_LONG)


@query
def score_store_rerun(t: Case) -> DataFrame:
    """Scores of two phenotypes stored, then those of one replaced by a run that corrects nothing."""
    names, cases = ["model", "d_bar", "p_d", "dic", "phenotype"], t.study_cases()
    scores = append(*[posterior.model_scores(t.draws_wide(), cases, name) for name in ("sma", "rd")]).select(*names)
    path = write_table(scores, new_path(t.spark, "scores"), partition_by=["phenotype"])
    replace_partitions(posterior.model_scores(t.draws_wide(), cases, "rd", corrected=False).select(*names), path, ["phenotype"])
    return read_table(t.spark, path, schemas.SCORES)


@query
def constancy_violations(t: Case) -> DataFrame:
    """Values that should be one for each study (site, age of a study) and are several; sites do have several populations."""
    years = cleaning.study_rows(cleaning.read_population(*t.population_parts())).withColumn("n_age", F.col("n_age").cast("long"))
    surveys = t.survey_rows()
    population = t.population().withColumn("total_population", F.col("total_population").cast("long"))
    looked = {
        "population of a study": (population, ["site", "period"], "total_population"),
        "population of a site in all periods": (population, ["site"], "total_population"),
        "person-years of an age": (years, ["study_id", "age_years"], "n_age"),
        "detection method": (surveys, ["study_id"], "detection_method"),
        "survey size": (surveys, ["study_id"], "number"),
    }
    return append(*[g.constancy(df, keys, value, rule) for rule, (df, keys, value) in looked.items()])


@query
def score_store_roundtrip(t: Case) -> DataFrame:
    draws = t.draws_wide()
    scores = posterior.model_scores(draws, t.study_cases(), "sma").select("model", "d_bar", "p_d", "dic", "phenotype")
    path = write_table(scores, new_path(t.spark, "scores"), partition_by=["phenotype"])
    return read_table(t.spark, path, schemas.SCORES)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.replace("\n", " ").split(",")]
