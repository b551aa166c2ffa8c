"""Numeric column expressions shared by features, statistics and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(default))


def sanitise(value: Column) -> Column:
    """Null, NaN and both infinities become 0."""
    v = value.cast("double")
    bad = v.isNull() | F.isnan(v) | v.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(0.0)).otherwise(v)


def entropy_bits(total: Column, sum_n_log2_n: Column) -> Column:
    """Shannon entropy from counts n that add up to ``total``: log2(total) - sum(n * log2(n)) / total."""
    return F.when(total > 0, F.log2(total.cast("double")) - sum_n_log2_n / total).otherwise(F.lit(0.0))


# Chebyshev coefficients of log(erfc(z) * (2 + z) / 2) + z * z over t = 2 / (2 + z), z >= 0.
_ERFC = [
    -1.3026537197817094, 6.4196979235649026e-1, 1.9476473204185836e-2, -9.561514786808631e-3,
    -9.46595344482036e-4, 3.66839497852761e-4, 4.2523324806907e-5, -2.0278578112534e-5,
    -1.624290004647e-6, 1.303655835580e-6, 1.5626441722e-8, -8.5238095915e-8, 6.529054439e-9,
    5.059343495e-9, -9.91364156e-10, -2.27365122e-10, 9.6467911e-11, 2.394038e-12, -6.886027e-12,
    8.94487e-13, 3.13092e-13, -1.12708e-13, 3.81e-16, 7.106e-15, -1.523e-15, -9.4e-17, 1.21e-16, -2.8e-17,
]


def erfc(z: Column) -> Column:
    """Complementary error function; Spark has none built in. Relative error below 1e-13."""
    a = F.abs(z)
    t = F.lit(2.0) / (a + 2.0)
    ty = t * 4.0 - 2.0
    coefficients = F.array(*[F.lit(c) for c in reversed(_ERFC[1:])])
    # Clenshaw recurrence as a fold over the coefficients, highest first.
    pair = F.aggregate(
        coefficients,
        F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("dd"), ty.alias("ty")),
        lambda s, c: F.struct(
            (s["ty"] * s["d"] - s["dd"] + c).alias("d"), s["d"].alias("dd"), s["ty"].alias("ty")
        ),
    )
    # After the last step d belongs to coefficient 1 and dd to coefficient 2.
    tail = F.exp(-a * a + 0.5 * (_ERFC[0] + ty * pair["d"]) - pair["dd"]) * t
    return F.when(z >= 0, tail).otherwise(2.0 - tail)


def logistic(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))
