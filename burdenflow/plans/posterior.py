"""Posterior draws: summaries, chains, curves, age profiles and model scores.

Draws come wide, one row per kept iteration with a column per parameter. Grids are made by
exploding fixed steps inside a row, never by joining draws to a grid table, and everything
that needs all grid points of one draw is computed before the explode. What is left to
shuffle is the quantile across draws.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from burdenflow.functions import clinical as c
from burdenflow.functions.rates import LOG_PER, correction, expected_rate, linear_predictor, log_lik, rate_at
from burdenflow.functions.special import gamma_log_scale
from burdenflow.functions.text import parameter_index
from burdenflow.operators.groups import delta_from_best
from burdenflow.operators.joins import natural_join
from burdenflow.operators.ordering import hdi, order_by_statistic, prefix_sums, quantiles, sample_rows, spread
from burdenflow.operators.shaping import (
    append,
    filter_parameter,
    grid,
    rename_matching,
    select_matching,
    single,
    step_value,
    to_long,
)
from burdenflow.sources.weights import numbers

IDS = ["chain", "iteration"]
BANDS = {"q01": 0.01, "q025": 0.025, "median": 0.5, "q975": 0.975, "q99": 0.99}
MIDDLE = {"median": 0.5, "q025": 0.025, "q975": 0.975}
LAG_BLOCK = 50_000


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def concat_chains(*chains: DataFrame) -> DataFrame:
    """Stack the draws of several chains; the chain stays a column."""
    return append(*chains)


def indexed(draws: DataFrame, family: str) -> dict[int, str]:
    """Columns of a parameter family by index, as ``PR[1]``, ``PR[2]``; empty if not monitored."""
    found = {c: re.fullmatch(rf"{re.escape(family)}\[(\d+)\]", c) for c in draws.columns}
    return {int(m.group(1)): c for c, m in found.items() if m}


def shared_indexes(draws: DataFrame, families: Sequence[str]) -> list[int]:
    """Indexes that all of the families have."""
    return sorted(set.intersection(*[set(indexed(draws, family)) for family in families]))


def site_draws(draws: DataFrame, families: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per draw and index ``idx``, from indexed families: ``families`` maps a family to a column."""
    columns = {family: indexed(draws, family) for family in families}
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("idx"), *[col(columns[f][i]).alias(n) for f, n in families.items()])
            for i in shared_indexes(draws, list(families))
        ]
    )
    return draws.select(*[col(k) for k in keep], F.inline(entries))


def draw_rows(draws: DataFrame, families: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per draw and index ``idx``, as ``site_draws`` makes, from unpivoted columns met again by index and draw.

    What it costs grows with the draws, not with an expression that holds every index; meant to be stored once.
    """
    shared = set(shared_indexes(draws, list(families)))
    wanted = [name for family in families for i, name in indexed(draws, family).items() if i in shared]
    ids = [*IDS, *[k for k in keep if k not in IDS]]
    tall = draws.unpivot([col(k) for k in ids], [col(name) for name in wanted], "parameter", "value")
    parts = lambda n: F.regexp_extract("parameter", r"^(.*)\[(\d+)\]$", n)
    tall = tall.withColumns({"family": parts(1), "idx": parts(2).cast("int")})
    values = [F.max(F.when(F.col("family") == family, F.col("value"))).alias(name) for family, name in families.items()]
    return tall.groupBy("idx", *ids).agg(*values)


def at_stored_studies(store: DataFrame, studies: DataFrame, indexes: int) -> DataFrame:
    """Stored draws of every study: the studies are dealt out to the store's buckets, the draws stay where they are."""
    numbered = studies.withColumn("idx", F.pmod(F.col("study_number") - 1, F.lit(indexes)).cast("int") + 1)
    return store.join(numbered.hint("merge"), "idx").drop("idx")


def at_studies(rows: DataFrame, studies: DataFrame, indexes: int, number: str = "study_number") -> DataFrame:
    """Rows of an index for every study that has it: study numbers go through the indexes again and again."""
    idx = F.pmod(F.col(number) - 1, F.lit(indexes)) + 1
    return studies.withColumn("idx", idx).join(rows, "idx", "left").drop("idx")


def summarise(draws: DataFrame, probs: Mapping[str, float] = BANDS) -> DataFrame:
    """Quantiles of every parameter."""
    values = to_long(draws.drop(*IDS, "model"), [])
    return quantiles(values, ["parameter"], "value", probs)


def summarise_by(draws: DataFrame, by: str, probs: Mapping[str, float] = BANDS) -> DataFrame:
    """Quantiles of every parameter for each value of a column of the draws."""
    return quantiles(to_long(draws.drop(*IDS, "model"), [by]), [by, "parameter"], "value", probs)


def summarise_models(draws: DataFrame, probs: Mapping[str, float] = BANDS) -> DataFrame:
    """Quantiles of every parameter of every model, over all its chains; long draws."""
    return quantiles(draws, ["model", "parameter"], "value", probs)


def summarise_dense(draws: DataFrame, mass: float = 0.95) -> DataFrame:
    """Median and densest interval of every parameter."""
    values = to_long(draws.drop(*IDS, "model"), [])
    medians = quantiles(values, ["parameter"], "value", {"median": 0.5}).drop("n")
    return medians.join(hdi(values, ["parameter"], "value", mass), "parameter")


def fold_change(draws: DataFrame, points: float = 25.0) -> DataFrame:
    """Fold change of the rate for a rise of prevalence by so many points, linear model."""
    fold = F.exp(F.col("beta1") * F.lit(points / 100))
    values = draws.select(F.lit(points).alias("points"), fold.alias("fold"))
    return quantiles(values, ["points"], "fold", MIDDLE)


def sampled_site_draws(draws: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Site effects of sampled draws, and the prevalences of the same draws, by study."""
    effects, prevalences = indexed(draws, "RE"), indexed(draws, "PR_corrected")
    sampled = sample_rows(draws.select(*[col(c) for c in (*IDS, *effects.values(), *prevalences.values())]), IDS, n, seed)
    none = F.lit(None).cast("double")
    entries = [
        F.struct(
            F.lit(i).alias("study_number"), col(effects[i]).alias("re"),
            (col(prevalences[i]) if i in prevalences else none).alias("pr"),
        )
        for i in sorted(effects)
    ]
    return sampled.select(*IDS, F.inline(F.array(*entries)))


def chain_diagnostics(draws: DataFrame, lags: Sequence[int] = (1, 10), block_rows: int = LAG_BLOCK) -> DataFrame:
    """Mean, sd, R-hat and autocorrelations of every parameter.

    Chains are cut into blocks of positions. A block also gets the last rows of the block
    before it, so that every row finds its earlier values without sorting a whole chain.
    """
    names = [c for c in draws.columns if c not in (*IDS, "model")]
    reach = max(lags)
    packed = draws.select(*IDS, F.array(*[col(n) for n in names]).alias("values"))
    placed = prefix_sums(packed, ["iteration"], by=["chain"], name="position")
    own = F.floor(F.col("position") / block_rows)
    later = F.floor((F.col("position") + reach) / block_rows)
    blocks = placed.withColumn("own", own).withColumn("block", F.explode(F.sequence(own, later)))
    order = Window.partitionBy("chain", "block").orderBy("position")
    before = {f"lag_{k}": F.lag("values", k).over(order) for k in lags}
    pairs = blocks.withColumns(before).where("own = block")
    entries = F.arrays_zip(
        F.array(*[F.lit(n) for n in names]).alias("parameter"),
        F.col("values").alias("value"),
        *[F.coalesce(f"lag_{k}", F.array_repeat(F.lit(None).cast("double"), len(names))).alias(f"lag_{k}") for k in lags],
    )
    values = pairs.select("chain", F.inline(entries))
    per_chain = values.groupBy("parameter", "chain").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.var_samp("value").alias("variance"),
        *[F.corr("value", f"lag_{k}").alias(f"acf_{k}") for k in lags],
    )
    total = per_chain.groupBy("parameter").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("chains"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        F.sum((F.col("n") - 1) * F.col("variance")).alias("ss_within"),
        (F.var_samp("mean")).alias("between"),
        F.avg("variance").alias("within"),
        F.avg("n").alias("length"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("ss_means"),
        *[F.avg(f"acf_{k}").alias(f"acf_{k}") for k in lags],
    )
    ss = F.col("ss_within") + F.col("ss_means") - F.col("n") * F.col("mean") * F.col("mean")
    pooled = (F.col("length") - 1) / F.col("length") * F.col("within") + F.col("between")
    return total.select(
        "parameter", "n", "chains", "mean", F.sqrt(ss / (F.col("n") - 1)).alias("sd"),
        F.sqrt(F.try_divide(pooled, F.col("within"))).alias("r_hat"), *[f"acf_{k}" for k in lags],
    )


def upper_prevalence(draws: DataFrame, studies: DataFrame, family: str = "PR_corrected") -> Column:
    """Highest upper bound of prevalence among the studies."""
    bounds = quantiles(site_draws(draws, {family: "pr"}), ["idx"], "pr", {"q975": 0.975})
    found = at_studies(bounds, studies.select("study_number"), len(indexed(draws, family)))
    return single(found, F.max("q975"))


def fitted_curve(draws: DataFrame, form: str, points: int, upper: float | Column, label: str) -> DataFrame:
    """Rate per 1,000 over prevalence 0..upper: median and bounds across draws."""
    parameters = {"logistic": ["intercept", "beta1", "beta2"], "linear": ["intercept", "beta1"], "intercept": ["intercept"]}
    chosen = draws.select(*parameters[form])
    top = upper if isinstance(upper, Column) else F.lit(float(upper))
    if form == "intercept":
        # the curve is flat: its bounds are those of one parameter
        flat = quantiles(chosen.withColumn("curve", F.lit(label)), ["curve"], "intercept", BANDS)
        rows = grid(flat, points, "step").withColumn("pr", F.col("step") * (top / (points - 1)))
    else:
        stepped = grid(spread(chosen), points, "step").withColumn("pr", F.col("step") * (top / (points - 1)))
        beta2 = F.col("beta2") if form == "logistic" else None
        fits = stepped.withColumn("fit", linear_predictor(form, F.col("pr"), F.col("intercept"), F.col("beta1"), beta2))
        found = quantiles(fits, ["step"], "fit", BANDS)
        rows = found.withColumn("pr", F.col("step") * (top / (points - 1)))
    return rows.select(
        F.lit(label).alias("curve"), "step", c.percent(F.col("pr")).alias("pr"),
        *[F.exp(F.col(q) + LOG_PER).alias(q) for q in BANDS],
    )


def curves_union(curves: Mapping[int, DataFrame]) -> DataFrame:
    """Curves in one table, with their place in the display order and the highest bound of all."""
    placed = append(*[df.withColumn("place", F.lit(place)) for place, df in curves.items()])
    return placed.withColumn("rate_max", single(placed, F.max("q99")))


DENSE = ["median", "lower", "upper"]


def study_points(summary: DataFrame, sites: DataFrame, names: Sequence[str] = tuple(BANDS), by: Sequence[str] = ()) -> DataFrame:
    """Fitted prevalence and imputed rate of every study beside each other, from a summary of the draws.

    ``names`` are the statistics of the summary. ``sites`` are studies with ``py`` and what
    else is shown of them. ``by`` are columns of the summary whose values, as phenotypes, have
    draws of their own: every study has a row for each.
    """
    number = parameter_index(F.col("parameter")).alias("idx")
    prevalence = filter_parameter(summary, "PR_corrected", exclude="PR_corrected_mic").select(
        *by, number, *[c.percent(F.col(q)).alias(f"pr_{q}") for q in names]
    )
    admissions = filter_parameter(summary, "estimated_admissions").select(
        *by, number, *[F.col(q).alias(f"est_{q}") for q in names]
    )
    # as many indexes as the family has
    idx = F.pmod(F.col("study_number") - 1, single(prevalence, F.count_distinct("idx"))) + 1
    points = sites.withColumn("idx", idx).join(prevalence.join(admissions, [*by, "idx"], "left"), "idx", "left")
    shown = [name for name in sites.columns if name not in ("site", "period", "py")]
    rates = [c.rate(F.col(f"est_{q}"), F.col("py")).alias(f"rate_{q}") for q in names]
    return points.select(*by, *shown, *[f"pr_{q}" for q in names], *rates)


def with_observed_rates(points: DataFrame, observed: DataFrame, curve: str) -> DataFrame:
    """The points, those of one curve with the observed rate alone, as median."""
    found = observed.select("study_id", F.col("rate").alias("_rate"))
    joined = natural_join(points, found, "left", on=["study_id"], null_safe=False)
    none = F.lit(None).cast("double")
    rates = {
        name: F.when(F.col("curve") == curve, F.col("_rate") if name == "rate_median" else none).otherwise(F.col(name))
        for name in points.columns if name.startswith("rate_")
    }
    return joined.withColumns(rates).drop("_rate")


def point_sites(studies: DataFrame, population: DataFrame, methods: DataFrame, crude: DataFrame) -> DataFrame:
    """Studies with person-years, detection method and the prevalence that their survey alone gives, on both scales."""
    placed = natural_join(studies.join(population, "study_id", "left"), methods, "left", on=["site", "period"])
    survey = crude.select(
        "study_id", c.percent(F.col("pr_mic")).alias("pr_survey_mic"), c.percent(F.col("pr_corrected")).alias("pr_survey")
    )
    return natural_join(placed, survey, "left", on=["study_id"], null_safe=False)


def modal_age(draws: DataFrame, steps: int = 76, per: int = 100) -> DataFrame:
    """Age of most admissions per prevalence, with bounds; on draws by prevalence, not by age."""
    stepped = grid(spread(draws.select(col("alpha_parm[2]").alias("a2"), col("betas[2]").alias("b2"))), steps, "pr_index")
    fits = stepped.withColumn("fit", F.col("a2") + F.col("b2") * step_value(F.col("pr_index"), per=per))
    found = quantiles(fits, ["pr_index"], "fit", MIDDLE)
    return found.select(
        "pr_index", c.percent(step_value(F.col("pr_index"), per=per)).alias("pr"),
        *[F.exp(q).alias(f"age_{q}") for q in MIDDLE],
    )


def threshold_summary(draws: DataFrame) -> DataFrame:
    """Median and bounds, in percent, of the prevalence above which age matters."""
    crit = draws.select(F.lit(1).alias("one"), col("PR_crit").alias("crit"))
    found = quantiles(crit, ["one"], "crit", MIDDLE)
    return found.select(*[c.percent(F.col(q)).alias(f"cut_{q}") for q in MIDDLE])


def monthly_ages(years: int = 10) -> list[float]:
    return [month / 12 for month in range(12 * years + 1)]


def site_ages() -> list[float]:
    """Band edges of completed years: three months at the start, then yearly."""
    return [0.0, *[year - 0.25 for year in range(1, 11)]]


def _bands(ages: Sequence[float]) -> Column:
    """Constant array of the bands between consecutive ages, logarithms included."""

    def number(value: float | None) -> str:
        return "CAST(NULL AS DOUBLE)" if value is None else f"{value!r}D"

    def entry(k: int, lo: float, hi: float) -> str:
        logs = [math.log(a) if a > 0 else None for a in (lo, hi)]
        values = ", ".join(number(v) for v in (lo, hi, hi - lo, *logs))
        return f"({k}, {values})"

    entries = ", ".join(entry(k, lo, hi) for k, (lo, hi) in enumerate(zip(ages, ages[1:])))
    kind = "ARRAY<STRUCT<band: INT, age: DOUBLE, next: DOUBLE, width: DOUBLE, log_age: DOUBLE, log_next: DOUBLE>>"
    return F.expr(f"CAST(array({entries}) AS {kind})")


def age_profile(
    rows: DataFrame, ages: Sequence[float], below: str = "uniform", rule: str = "right", flat: float = 0.1
) -> DataFrame:
    """Spread each row's rate over age bands.

    Input columns: pr, a2, b2, sigma, crit (a gamma profile whose mode is exp(a2 + b2 * pr)).
    Adds ``band``, ``age`` and ``share``. The share of a band is the density at its end times
    its width (``trapezoid``: at both ends) over the sum of all bands; at or below the
    threshold all bands are alike (``uniform``), or ``flat`` each if so asked. The sum is
    formed within the row, so no shuffle is needed to normalise.
    """
    bands = _bands(ages)
    mode = F.exp(F.col("a2") + F.col("b2") * F.col("pr"))
    root = F.sqrt(F.col("mode") * F.col("mode") + 4 * F.col("sigma") * F.col("sigma"))
    shaped = (
        rows.withColumn("mode", mode)
        .withColumn("rate", (F.col("mode") + root) / (2 * F.col("sigma") * F.col("sigma")))
        .withColumn("shape", 1 + F.col("mode") * F.col("rate"))
        .withColumn("scale", gamma_log_scale(F.col("shape"), F.col("rate")))
    )

    def density(log_age: Column, age: Column) -> Column:
        value = F.exp(F.col("scale") + (F.col("shape") - 1) * log_age - F.col("rate") * age)
        return F.coalesce(value, F.lit(0.0))

    def weight(b) -> Column:
        end = density(b("log_next"), b("next"))
        if rule == "trapezoid":
            return (density(b("log_age"), b("age")) + end) / 2 * b("width")
        return end * b("width")

    total = F.aggregate(bands, F.lit(0.0), lambda acc, s: acc + weight(lambda name: s[name]))
    opened = shaped.withColumn("total", total).select("*", F.inline(bands))
    level = F.lit(1 / (len(ages) - 1)) if below == "uniform" else F.lit(flat)
    share = F.when(F.col("pr") <= F.col("crit"), level).otherwise(F.try_divide(weight(F.col), F.col("total")))
    return opened.withColumn("share", share).select(*rows.columns, "band", "age", "share")


def _profile_parameters() -> list[Column]:
    names = {
        "alpha_parm[1]": "a1", "alpha_parm[2]": "a2", "betas[1]": "b1", "betas[2]": "b2", "sigma": "sigma", "PR_crit": "crit",
    }
    return [col(old).alias(new) for old, new in names.items()]


def age_surface(
    draws: DataFrame, steps: int = 76, per: int = 100, ages: Sequence[float] | None = None,
    chosen: Sequence[int] | None = None,
) -> DataFrame:
    """Admission rate by age and prevalence: median, bounds and inter-quartile range over draws.

    ``chosen`` keeps some prevalence steps only, before anything is computed for the others.
    """
    stepped = grid(spread(draws.select(*_profile_parameters())), steps, "pr_index")
    if chosen is not None:
        stepped = stepped.where(F.col("pr_index").isin(list(chosen)))
    placed = stepped.withColumn("pr", step_value(F.col("pr_index"), per=per))
    profile = age_profile(placed, ages or monthly_ages())
    fits = profile.select(
        "pr_index", "band", (F.col("share") * rate_at(F.col("pr"), F.col("a1"), F.col("b1"))).alias("fit")
    )
    probs = {**MIDDLE, "q25": 0.25, "q75": 0.75}
    found = quantiles(fits, ["pr_index", "band"], "fit", probs)
    ends = numbers(ages or monthly_ages())
    return found.select(
        "pr_index", "band", c.percent(step_value(F.col("pr_index"), per=per)).alias("pr"),
        F.get(ends, F.col("band")).alias("age"), *MIDDLE, (F.col("q75") - F.col("q25")).alias("iqr"),
    )


def site_age_fit(draws: DataFrame, studies: DataFrame, with_effect: bool = False) -> DataFrame:
    """Fitted rate by study and age band, and the study's prevalence; studies ranked by it.

    The site effect belongs to the draws but is not part of the published rate. Fits are made
    for each index of the draws, and every study takes those of its index.
    """
    names = ["a1", "a2", "b1", "b2", "sigma", "crit"]
    families = {"RE": "re", "PR_corrected": "pr"}
    wanted = [col(old) for family in families for old in indexed(draws, family).values()]
    sites = site_draws(spread(draws.select(*_profile_parameters(), *wanted)), families, keep=names)
    fits = age_profile(sites, site_ages()).withColumn(
        "fit", F.col("share") * rate_at(F.col("pr"), F.col("a1"), F.col("b1"), F.col("re") if with_effect else 0.0)
    )
    indexes, numbered = len(shared_indexes(draws, list(families))), studies.select("study_number")
    fitted = at_studies(quantiles(fits, ["idx", "band", "age"], "fit", MIDDLE).drop("n"), numbered, indexes)
    prevalence = at_studies(quantiles(sites, ["idx"], "pr", MIDDLE), numbered, indexes).select(
        "study_number", *[c.percent(F.col(q)).alias(f"pr_{q}") for q in MIDDLE]
    )
    ranked = order_by_statistic(prevalence, ["study_number"], "pr_median")
    return fitted.join(ranked, "study_number")


def site_age_observed(
    cases: DataFrame, draws: DataFrame, fitted: DataFrame, studies: DataFrame, indexes: int
) -> DataFrame:
    """Observed and imputed rates by study and age beside the fitted ones.

    ``draws`` are long, by index from 1 to ``indexes``; the numbered rows of ``cases`` go
    through the indexes. Ages are matched by quarter years, as whole numbers.
    """
    found = quantiles(draws, ["idx"], "value", MIDDLE).drop("n")
    imputed = at_studies(found, cases, indexes, "rn").select(
        "study_id", F.when(F.col("age_years") > 0, F.col("age_years") * 4 - 1).otherwise(F.col("age_years") * 4).alias("quarter"),
        "rn", "n", "n_alt", "py", "rate", "rate_alt",
        *[c.rate(F.col(q), F.col("py")).alias(f"site_{q}") for q in MIDDLE],
    )
    named = fitted.join(studies.select("study_number", "study_id"), "study_number", "left").select(
        "study_id", (F.col("age") * 4).cast("int").alias("quarter"), *[F.col(q).alias(f"fit_{q}") for q in MIDDLE]
    )
    return natural_join(named, imputed, "full", on=["study_id", "quarter"])


FORMS = {
    "poisson_logistic": ("poisson", "logistic"),
    "nb_logistic": ("negbin", "logistic"),
    "nb_linear": ("negbin", "linear"),
    "nb_intercept": ("negbin", "intercept"),
}


def _study_draws(draws: DataFrame, studies: DataFrame) -> DataFrame:
    """Draws of every study with the study's cases and person-years."""
    sites = site_draws(draws, SCORE_FAMILIES, keep=[*IDS, *SCORE_PARAMETERS])
    return at_studies(sites, studies.select("study_number", "n", "py"), len(shared_indexes(draws, list(SCORE_FAMILIES))))


def _rate(form: str) -> Column:
    return expected_rate(form, F.col("pr"), F.col("py"), F.col("intercept"), F.col("beta1"), F.col("beta2"))


SCORE_FAMILIES, SCORE_PARAMETERS = {"PR_corrected": "pr", "estimated_admissions": "est"}, ["intercept", "beta1", "beta2", "r"]


def expected_rates(draws: DataFrame, studies: DataFrame) -> DataFrame:
    """Expected admissions per draw and study under each response form, and the correction."""
    return rates_of(_study_draws(draws, studies))


def rates_of(rows: DataFrame) -> DataFrame:
    """``expected_rates`` of draws that stand beside their studies."""
    forms = {f"lambda_{form}": _rate(form) for form in ("logistic", "linear", "intercept")}
    return rows.select(
        *IDS, "study_number", *[rate.alias(name) for name, rate in forms.items()],
        correction(forms["lambda_linear"], F.col("est")).alias("correction"),
    )


def model_scores(draws: DataFrame, studies: DataFrame, phenotype: str, corrected: bool = True) -> DataFrame:
    """Mean deviance, effective parameters and DIC of each model, with the distance to the best.

    The effective number of parameters is half the variance of the deviance. Phenotypes with
    imputed cases have their mean corrected by the estimate, cerebral cases have not.
    """
    return scores_of(_study_draws(draws, studies), phenotype, corrected)


def scores_of(rows: DataFrame, phenotype: str, corrected: bool = True) -> DataFrame:
    """``model_scores`` of draws that stand beside their studies."""
    factor = lambda form: correction(_rate(form), F.col("est")) if corrected else F.lit(1.0)
    means = {form: _rate(form) * factor(form) for form in ("logistic", "linear", "intercept")}
    deviance = {
        model: -2 * F.sum(log_lik(family, F.col("n").cast("double"), means[form], F.col("r")))
        for model, (family, form) in FORMS.items()
    }
    per_draw = rows.groupBy(*IDS).agg(*[d.alias(m) for m, d in deviance.items()])
    tall = to_long(per_draw, IDS, "model", "deviance")
    scores = tall.groupBy("model").agg(
        F.avg("deviance").alias("d_bar"), (F.var_samp("deviance") / 2).alias("p_d")
    )
    scored = scores.withColumn("dic", F.col("d_bar") + F.col("p_d")).withColumn("phenotype", F.lit(phenotype))
    return delta_from_best(scored, ["phenotype"], "dic")


def sampled_parameters(draws: DataFrame, n: int, pattern: str, seed: int = 7) -> DataFrame:
    """Sampled draws of the parameters that match, brackets stripped from their names."""
    return rename_matching(sample_rows(select_matching(draws, pattern, keep=IDS), IDS, n, seed), r"[\[\]]")
