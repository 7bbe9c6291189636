"""Normal and beta distributions and gamma functions that Spark SQL lacks, as column expressions.

Coefficients are the published ones: Hart (1968) in West's (2005) form for the normal
distribution function, Wichura's AS 241 (1988) for its inverse, and a nine-term Lanczos
series (g = 7) for log-gamma. The beta distribution function is the continued fraction of
the incomplete beta function (DLMF 8.17.22), worked out from its far end; its inverse is
found by Newton steps that a bracket keeps inside.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

# fixed values: rational approximation of the normal tail, highest power first
TAIL_NUM = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376]
TAIL_DEN = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]

# fixed values: inverse normal, centre / middle / far tail, highest power first
CENTRE_NUM = [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
              13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608]
CENTRE_DEN = [5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
              5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0]
MIDDLE_NUM = [7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
              3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734]
MIDDLE_DEN = [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
              0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0]
TAIL_INV_NUM = [2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
                0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
                5.4637849111641143699, 6.6579046435011037772]
TAIL_INV_DEN = [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.8463183175100546818e-5,
                7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
                0.59983220655588793769, 1.0]

# fixed values: Lanczos series for log-gamma, g = 7
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
           -176.61502916214059, 12.507343278686905, -0.13857109526572012,
           9.9843695780195716e-6, 1.5056327351493116e-7]

PROBABILITY_MARGIN = 1e-12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def horner(x: Column, coefficients: list[float]) -> Column:
    return reduce(lambda acc, k: acc * x + F.lit(k), coefficients[1:], F.lit(coefficients[0]))


def norm_cdf(c: Column) -> Column:
    """Standard normal distribution function."""
    return let(c, _norm_cdf)


def _norm_cdf(c: Column) -> Column:
    z = F.abs(c)
    density = F.exp(-z * z / 2)
    near = density * horner(z, TAIL_NUM) / horner(z, TAIL_DEN)
    fraction = reduce(lambda acc, k: z + F.lit(float(k)) / acc, (4, 3, 2, 1), z + F.lit(0.65))
    far = density / fraction / F.lit(2.506628274631)
    tail = F.when(z > 37, F.lit(0.0)).when(z < 7.07106781186547, near).otherwise(far)
    return F.when(c > 0, 1 - tail).otherwise(tail)


def probit(c: Column) -> Column:
    """Inverse of the normal distribution function; input kept inside (0, 1)."""
    p = F.greatest(F.least(c, F.lit(1 - PROBABILITY_MARGIN)), F.lit(PROBABILITY_MARGIN))
    return let(F.when(c.isNotNull(), p), _probit)


def _probit(p: Column) -> Column:
    q = p - 0.5
    centre = let(
        F.lit(0.180625) - q * q, lambda u: q * horner(u, CENTRE_NUM) / horner(u, CENTRE_DEN)
    )
    middle = lambda r: horner(r - 1.6, MIDDLE_NUM) / horner(r - 1.6, MIDDLE_DEN)
    far = lambda r: horner(r - 5, TAIL_INV_NUM) / horner(r - 5, TAIL_INV_DEN)
    size = let(F.sqrt(-F.log(F.least(p, 1 - p))), lambda r: F.when(r <= 5, middle(r)).otherwise(far(r)))
    return F.when(F.abs(q) <= 0.425, centre).when(q < 0, -size).otherwise(size)


def lgamma(c: Column) -> Column:
    """Logarithm of the gamma function for arguments of at least one half."""
    x = c - 1
    series = reduce(
        lambda acc, term: acc + F.lit(term[1]) / (x + term[0]),
        enumerate(LANCZOS[1:], start=1),
        F.lit(LANCZOS[0]),
    )
    t = x + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x + 0.5) * F.log(t) - t + F.log(series)


def gamma_log_scale(shape: Column, rate: Column) -> Column:
    """Log of the factor of a gamma density that does not depend on its argument."""
    return shape * F.log(rate) - lgamma(shape)


def log_beta(a: Column, b: Column) -> Column:
    """Logarithm of the beta function for arguments of at least one half."""
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def beta_cdf(x: Column, a: Column, b: Column) -> Column:
    """Distribution function of a beta variable with parameters of at least one half.

    The terms worked out grow with the square root of the parameters, as the fraction's
    convergence does.
    """
    given = F.struct(x.cast("double").alias("x"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    known = x.isNotNull() & a.isNotNull() & b.isNotNull()
    return let(F.when(known, given), lambda v: let(log_beta(v["a"], v["b"]), lambda k: _beta_cdf(v["x"], v["a"], v["b"], k)))


def _beta_cdf(x: Column, a: Column, b: Column, log_b: Column) -> Column:
    low = _beta_tail(x, a, b, log_b)
    high = 1 - _beta_tail(1 - x, b, a, log_b)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(x * (a + b + 2) < a + 1, low).otherwise(high)


def _beta_tail(x: Column, a: Column, b: Column, log_b: Column) -> Column:
    terms = (F.lit(40) + 4 * F.sqrt(F.greatest(a, b))).cast("int")

    def outer(inner: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = (a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + even / (1 - odd / inner)

    inner = F.aggregate(F.sequence(terms, F.lit(1), F.lit(-1)), F.lit(1.0), outer)
    fraction = 1 - (a + b) * x / ((a + 1) * inner)
    return F.exp(a * F.log(x) + b * F.log1p(-x) - log_b) / (a * fraction)


def beta_quantile(p: Column, a: Column, b: Column, steps: int = 80) -> Column:
    """Inverse of ``beta_cdf`` for probabilities inside (0, 1).

    A step that leaves the bracket halves it instead; steps end where they no longer move.
    """
    given = F.struct(p.cast("double").alias("p"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    known = (p > 0) & (p < 1) & a.isNotNull() & b.isNotNull()
    return let(F.when(known, given), lambda v: let(log_beta(v["a"], v["b"]), lambda k: _beta_quantile(v, k, steps)))


def _beta_quantile(v: Column, log_b: Column, steps: int) -> Column:
    p, a, b = v["p"], v["a"], v["b"]
    mean = a / (a + b)
    near = mean + probit(p) * F.sqrt(mean * (1 - mean) / (a + b + 1))
    state = lambda low, high, x, still: F.struct(
        low.alias("low"), high.alias("high"), x.alias("x"), still.alias("still")
    )

    def step(s: Column, _: Column) -> Column:
        def moved(excess: Column) -> Column:
            low, high = F.when(excess < 0, s["x"]).otherwise(s["low"]), F.when(excess < 0, s["high"]).otherwise(s["x"])
            density = F.exp((a - 1) * F.log(s["x"]) + (b - 1) * F.log1p(-s["x"]) - log_b)
            # without density there is no step, and the bracket is halved
            newton = s["x"] - excess / F.when(density > 0, density)
            return let(
                F.struct(low.alias("low"), high.alias("high"), newton.alias("to")),
                lambda n: let(
                    F.when((n["to"] > n["low"]) & (n["to"] < n["high"]), n["to"]).otherwise((n["low"] + n["high"]) / 2),
                    lambda x: state(n["low"], n["high"], x, F.abs(x - s["x"]) <= 1e-15 * x),
                ),
            )

        return F.when(s["still"], s).otherwise(let(_beta_cdf(s["x"], a, b, log_b) - p, moved))

    inside = F.when((near > 0) & (near < 1), near).otherwise(mean)
    start = state(F.lit(0.0), F.lit(1.0), inside, F.lit(False))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["x"])
