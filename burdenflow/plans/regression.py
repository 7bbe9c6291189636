"""Regression of admissions on prevalence by iteratively reweighted least squares.

Each step is one aggregation of five sums per candidate, so the driver holds a handful of
numbers however many studies there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from burdenflow.functions.rates import log_lik

# shapes of the logistic feature that are tried first; the best is then refined between its neighbours
BETA2_GRID = [0.5 * k for k in range(1, 21)] + [float(k) for k in range(11, 21)]
REFINEMENTS, PARTS = 2, 20
TOLERANCE = 1e-9
MOST_STEPS = 100
# sums of squares below this share of their parts leave a slope undetermined
FLAT = 1e-10


@dataclass(frozen=True)
class Candidate:
    """Coefficients of one model; ``beta2`` shapes the logistic feature, ``r`` is the dispersion.

    No dispersion beyond Poisson is ``r`` None. ``steps`` and ``converged`` tell how it was found.
    """

    intercept: float
    beta1: float
    beta2: float | None = None
    r: float | None = None
    steps: int = 0
    converged: bool = False

    @property
    def literal(self) -> Column:
        values = {"intercept": self.intercept, "beta1": self.beta1, "beta2": self.beta2, "r": self.r}
        return F.struct(*[F.lit(v).cast("double").alias(k) for k, v in values.items()])


def _fitted(studies: DataFrame, form: str, candidates: Sequence[Candidate]) -> DataFrame:
    """Studies by candidate with the feature x and the fitted mean mu."""
    rows = studies.select("*", F.posexplode(F.array(*[k.literal for k in candidates])).alias("g", "m")).select("*", "m.*")
    feature = {
        "linear": F.col("pr"),
        "logistic": 1 / (1 + F.exp(-F.col("beta2") * F.col("pr"))),
        "intercept": F.lit(0.0),
    }[form]
    eta = F.col("intercept") + F.col("beta1") * F.col("x")
    return rows.withColumn("x", feature).withColumn("eta", eta).withColumn("mu", F.exp(F.col("eta")) * F.col("py"))


def _step(studies: DataFrame, form: str, candidates: Sequence[Candidate]) -> list[Candidate | None]:
    """One step of each candidate; None where the sums leave it undetermined."""
    weight = F.when(F.col("r").isNull(), F.col("mu")).otherwise(F.col("mu") / (1 + F.col("mu") / F.col("r")))
    w, x, z = F.col("w"), F.col("x"), F.col("z")
    sums = (
        _fitted(studies, form, candidates)
        .withColumn("w", weight)
        .withColumn("z", F.col("eta") + (F.col("n") - F.col("mu")) / F.col("mu"))
        .groupBy("g")
        .agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"), F.sum(w * z).alias("wz"), F.sum(w * x * z).alias("wxz"))
    )
    out: list[Candidate | None] = [None] * len(candidates)
    for s in sums.collect():  # one row per candidate
        if s.w is None or not math.isfinite(s.w) or s.w <= 0:
            continue
        if form == "intercept":
            a, b = s.wz / s.w, 0.0
        else:
            det = s.w * s.wxx - s.wx * s.wx
            if not det > FLAT * s.w * s.wxx:
                continue
            a, b = (s.wxx * s.wz - s.wx * s.wxz) / det, (s.w * s.wxz - s.wx * s.wz) / det
        old = candidates[s.g]
        settled = abs(a - old.intercept) + abs(b - old.beta1) < TOLERANCE * (1 + abs(a) + abs(b))
        out[s.g] = replace(old, intercept=a, beta1=b, steps=old.steps + 1, converged=settled)
    return out


def _converge(studies: DataFrame, form: str, candidates: Sequence[Candidate], most: int) -> list[Candidate]:
    """Step until every candidate has settled; those that become undetermined drop out."""
    current = [replace(k, steps=0, converged=False) for k in candidates]
    for _ in range(most):
        current = [k for k in _step(studies, form, current) if k]
        if all(k.converged for k in current):
            break
    return current


def _dispersion(studies: DataFrame, form: str, candidates: Sequence[Candidate]) -> list[Candidate]:
    """Size of the negative binomial by moments around the fitted Poisson means; None without excess."""
    mu, excess = F.col("mu"), (F.col("n") - F.col("mu")) * (F.col("n") - F.col("mu")) - F.col("mu")
    sums = _fitted(studies, form, candidates).groupBy("g").agg(F.sum(mu * mu).alias("mm"), F.sum(excess).alias("excess"))
    found = {s.g: s.mm / s.excess if s.excess > 0 else None for s in sums.collect()}
    return [replace(k, r=found[g]) for g, k in enumerate(candidates)]


def _scored(studies: DataFrame, family: str, form: str, candidates: Sequence[Candidate]) -> DataFrame:
    poisson = log_lik("poisson", F.col("n"), F.col("mu"))
    value = poisson if family == "poisson" else F.when(F.col("r").isNull(), poisson).otherwise(
        log_lik("negbin", F.col("n"), F.col("mu"), F.col("r"))
    )
    return _fitted(studies, form, candidates).groupBy("g", "intercept", "beta1", "beta2", "r").agg(
        F.sum(value).alias("log_lik"), F.count(F.lit(1)).alias("studies")
    )


def _best(studies: DataFrame, family: str, form: str, base: Candidate, shapes: Sequence[float | None], most: int) -> Candidate | None:
    fits = _converge(studies, form, [replace(base, beta2=b) for b in shapes], most)
    if family == "negbin" and fits:
        fits = _converge(studies, form, _dispersion(studies, form, fits), most)
    if len(fits) < 2:
        return fits[0] if fits else None
    scores = {s.g: s.log_lik for s in _scored(studies, family, form, fits).collect()}
    return fits[max(scores, key=lambda g: (scores[g], -g))]


def fit_rate(
    df: DataFrame, family: str = "poisson", form: str = "linear", grid: Sequence[float] = BETA2_GRID, most: int = MOST_STEPS
) -> DataFrame:
    """Coefficients of n ~ pr with a log(py) offset: one row with its log-likelihood.

    ``logistic`` fits the shapes of the grid side by side, keeps the likeliest and refines it
    between its neighbours; ``negbin`` fits a Poisson first, takes the dispersion by moments
    and fits again. ``converged`` and ``steps`` are those of the last fit. Without cases, or
    with one prevalence throughout where a slope is asked for, coefficients are NULL.
    """
    usable = df.where((F.col("py") > 0) & F.col("pr").isNotNull() & F.col("n").isNotNull())
    studies = usable.select(F.col("n").cast("double").alias("n"), "py", "pr").persist()
    start = studies.agg(F.sum("n").alias("n"), F.sum("py").alias("py")).first()
    best = None
    if start.n:
        base = Candidate(math.log(start.n / start.py), 0.0)
        shapes = sorted(grid) if form == "logistic" else [None]
        best = _best(studies, family, form, base, shapes, most)
        for _ in range(REFINEMENTS if form == "logistic" else 0):
            if best is None:
                break
            at = min(range(len(shapes)), key=lambda i: abs(shapes[i] - best.beta2))
            low, high = shapes[max(0, at - 1)], shapes[min(len(shapes) - 1, at + 1)]
            shapes = [low + (high - low) * (k / PARTS) for k in range(PARTS + 1)]
            best = _best(studies, family, form, base, shapes, most) or best
    studies.unpersist()
    named = [F.lit(family).alias("family"), F.lit(form).alias("form")]
    if best is None:
        none = [F.lit(None).cast("double").alias(name) for name in ("intercept", "beta1", "beta2", "r", "log_lik")]
        counted = studies.agg(F.count(F.lit(1)).alias("studies"))
        return counted.select(*named, *none, "studies", F.lit(False).alias("converged"), F.lit(0).alias("steps"))
    row = _scored(studies, family, form, [best])
    return row.select(
        *named, "intercept", "beta1", "beta2", "r", "log_lik", "studies",
        F.lit(best.converged).alias("converged"), F.lit(best.steps).alias("steps"),
    )
