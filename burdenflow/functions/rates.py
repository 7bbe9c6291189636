"""Admission-rate models: expected counts, corrections and log-likelihoods."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from burdenflow.functions.special import lgamma

LOG_PER = math.log(1000)

# fixed values: detection-method map from microscopy to rapid test, probit scale
DETECTION_SLOPE = 0.97
DETECTION_INTERCEPT = -0.22


def linear_predictor(
    form: str, pr: Column, intercept: Column, beta1: Column | None = None, beta2: Column | None = None
) -> Column:
    """Log rate per person-year: ``logistic``, ``linear`` or ``intercept`` in prevalence."""
    if form == "logistic":
        return intercept + beta1 / (1 + F.exp(-beta2 * pr))
    if form == "linear":
        return intercept + beta1 * pr
    if form == "intercept":
        return intercept
    raise ValueError(f"unknown response form: {form}")


def expected_rate(
    form: str, pr: Column, py: Column, intercept: Column, beta1: Column | None = None, beta2: Column | None = None
) -> Column:
    """Expected admissions with a log person-year offset."""
    return F.exp(linear_predictor(form, pr, intercept, beta1, beta2) + F.when(py > 0, F.log(py)))


def rate_at(pr: Column, a1: Column, b1: Column, re: Column | float = 0.0) -> Column:
    """Rate per 1,000 at a prevalence; the site effect is left out unless given."""
    effect = re if isinstance(re, Column) else F.lit(re)
    return F.exp(F.lit(LOG_PER) + a1 + b1 * pr + effect)


def correction(lam: Column, est: Column) -> Column:
    """Ratio of expected to estimated admissions, 1 where nothing was estimated.

    The model multiplies the expected count by this ratio, so its mean is lam * lam / est.
    """
    return F.when(est > 0, lam / est).otherwise(F.when(lam.isNotNull(), F.lit(1.0)))


def log_lik(family: str, y: Column, mu: Column, r: Column | None = None) -> Column:
    """Log-likelihood of one count: ``poisson`` or ``negbin`` with size r."""
    if family == "poisson":
        return y * F.log(mu) - mu - lgamma(y + 1)
    if family == "negbin":
        p = r / (r + mu)
        return lgamma(y + r) - lgamma(r) - lgamma(y + 1) + r * F.log(p) + y * F.log(1 - p)
    raise ValueError(f"unknown family: {family}")
