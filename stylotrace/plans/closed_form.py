"""A linear scorer that is pure aggregation, for experiments that plain SQL can repeat.

Diagonal discriminant: every feature contributes (x - midpoint) * (mean_ai - mean_human) / pooled
population variance, with all parameters from the training rows. Contributions do not depend on the
other features, so one job scores any number of feature subsets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylotrace.functions.numbers import logistic

SCORE_DIGITS = 9  # equal rows must get equal scores whatever the order of a sum


@dataclass
class Discriminant:
    """Per feature: midpoint, slope, standardised mean difference, training mean."""

    params: dict[str, tuple[float, float, float, float]]

    @property
    def features(self) -> list[str]:
        return list(self.params)

    def contribution(self, feature: str) -> Column:
        mid, slope, _, _ = self.params[feature]
        return (F.col(feature) - F.lit(mid)) * F.lit(slope)

    def score(self, features: Sequence[str] | None = None) -> Column:
        chosen = self.features if features is None else features
        total = sum((self.contribution(f) for f in chosen), F.lit(0.0))
        return F.round(total, SCORE_DIGITS)

    def transform(self, df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
        return df.withColumn("score", self.score(features)).withColumn("p", probability(F.col("score")))

    def importance(self) -> list[tuple[str, float]]:
        """Features by standardised mean difference, largest first; ties in name order."""
        return sorted(((f, v[2]) for f, v in self.params.items()), key=lambda fv: (-fv[1], fv[0]))


def probability(score: Column) -> Column:
    return F.round(logistic(score), SCORE_DIGITS)


def fit_discriminant(train: DataFrame, features: Sequence[str], y: str = "y") -> Discriminant:
    """Class means and pooled variances in one aggregate; the result is a handful of numbers per feature."""
    measures = [F.count_if(F.col(y) == c).alias(f"n{c}") for c in (0, 1)]
    for f in features:
        for c in (0, 1):
            value = F.when(F.col(y) == c, F.col(f).cast("double"))
            measures += [F.avg(value).alias(f"m{c}_{f}"), F.var_pop(value).alias(f"v{c}_{f}")]
    row = train.agg(*measures).first()
    if not row["n0"] or not row["n1"]:
        raise ValueError("training rows of both classes are needed")
    n0, n1 = row["n0"], row["n1"]
    params = {}
    for f in features:
        m0, m1 = row[f"m0_{f}"], row[f"m1_{f}"]
        v = (n0 * row[f"v0_{f}"] + n1 * row[f"v1_{f}"]) / (n0 + n1)
        slope = (m1 - m0) / v if v > 0 else 0.0
        effect = abs(m1 - m0) / math.sqrt(v) if v > 0 else 0.0
        params[f] = ((m0 + m1) / 2, slope, effect, (n0 * m0 + n1 * m1) / (n0 + n1))
    return Discriminant(params)
