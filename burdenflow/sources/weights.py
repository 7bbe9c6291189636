"""Age weights and the age curve of parasite prevalence."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# fixed values: population share of ages 1..85
AGE_SHARES = [
    0.03916203, 0.04464933, 0.0464907, 0.04703639, 0.04468962, 0.04430289, 0.04088593, 0.04048751, 0.0385978,
    0.03586601, 0.03665516, 0.02850493, 0.03038655, 0.02493861, 0.02169105, 0.01506840, 0.01481482, 0.01519726,
    0.01474023, 0.01553814, 0.01193805, 0.01220409, 0.01202119, 0.01202534, 0.01283806, 0.01083728, 0.01095784,
    0.01092874, 0.01067932, 0.01137331,
    0.01035001, 0.01035001, 0.01035001, 0.01035001, 0.01035001,
    0.008342426, 0.008342426, 0.008342426, 0.008342426, 0.008342426,
    0.00660059, 0.00660059, 0.00660059, 0.00660059, 0.00660059,
    0.004597861, 0.004597861, 0.004597861, 0.004597861, 0.004597861,
    0.003960774, 0.003960774, 0.003960774, 0.003960774, 0.003960774,
    0.003045687, 0.003045687, 0.003045687, 0.003045687, 0.003045687,
    0.002761077, 0.002761077, 0.002761077, 0.002761077, 0.002761077,
    0.001275367, 0.001275367, 0.001275367, 0.001275367, 0.001275367,
    0.001275367, 0.001275367, 0.001275367, 0.001275367, 0.001275367,
    0.001275367, 0.001275367, 0.001275367, 0.001275367, 0.001275367,
    0.001275367, 0.001275367, 0.001275367, 0.001275367, 0.001275367,
]
MAX_AGE = len(AGE_SHARES)

# fixed values: age curve of infection
EXPOSURE_RATE = 1.807675
DECLINE_START = 9.422033
DECLINE_SIZE = 0.446326
DECLINE_RATE = 0.070376


def numbers(values: Sequence[float]) -> Column:
    """Constant array of doubles."""
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")


def exposure(age: Column, b: float = EXPOSURE_RATE) -> Column:
    """Share ever infected by an age."""
    return 1 - F.exp(-F.lit(b) * age)


def detection(age: Column, s: float, alpha: float = DECLINE_START, c: float = DECLINE_RATE) -> Column:
    """Share of infections detected; falls with age from ``alpha`` on."""
    return F.when(age >= alpha, 1 - s * (1 - F.exp(-F.lit(c) * (age - alpha)))).otherwise(F.lit(1.0))


@dataclass(frozen=True)
class AgePreset:
    """How a year of age is read: at its midpoint or at its end, and how far detection falls."""

    name: str
    shift: float
    decline: float

    @cached_property
    def curve(self) -> list[float]:
        """Weighted curve of ages 1..85, for expressions that look ages up by position."""
        out = []
        for year, share in enumerate(AGE_SHARES, start=1):
            age = year - self.shift
            fall = 1 - math.exp(-DECLINE_RATE * (age - DECLINE_START)) if age >= DECLINE_START else 0.0
            out.append((1 - math.exp(-EXPOSURE_RATE * age)) * (1 - self.decline * fall) * share)
        return out


PRESETS = {
    "midpoint": AgePreset("midpoint", 0.5, math.exp(-DECLINE_SIZE)),
    "integer": AgePreset("integer", 0.0, 1 - DECLINE_SIZE),
}


def age_weights(spark: SparkSession, preset: str = "midpoint") -> DataFrame:
    """The 85 rows (age, w, p, f, pfs, cum_w, cum_pfs); the cumulative sums serve age windows."""
    setting = PRESETS[preset]
    rows = spark.range(1).select(F.posexplode(numbers(AGE_SHARES)).alias("pos", "w"))
    at = F.col("age") - F.lit(setting.shift)
    curve = (
        rows.select((F.col("pos") + 1).alias("age"), "w")
        .withColumns({"p": exposure(at), "f": detection(at, setting.decline)})
        .withColumn("pfs", F.col("p") * F.col("f") * F.col("w"))
    )
    # sums over the fixed list, so no ordering of rows is needed
    total = lambda values: F.aggregate(
        F.slice(numbers(values), F.lit(1), F.col("age")), F.lit(0.0), lambda a, v: a + v
    )
    return curve.withColumns({"cum_w": total(AGE_SHARES), "cum_pfs": total(setting.curve)})
