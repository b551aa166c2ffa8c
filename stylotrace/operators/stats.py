"""Statistics per feature. Ranks and quantiles come from counts per distinct value."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from stylotrace.functions.numbers import erfc, ratio
from stylotrace.operators.ordering import join_keys, long_form, prefix_sum

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _rows_per_feature(one_row: DataFrame, features: Sequence[str], fields: dict[str, str], keys=()) -> DataFrame:
    """Turn columns ``<prefix>_<feature>`` of an aggregate into one row per feature."""
    entries = [
        F.struct(F.lit(f).alias("feature"), *[F.col(f"{prefix}_{f}").alias(name) for name, prefix in fields.items()])
        for f in features
    ]
    return one_row.select(*keys, F.inline(F.array(*entries)))


def value_counts(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def quantiles(cumulated: DataFrame, keys: Sequence[str], points: dict[str, float], value: str = "value") -> DataFrame:
    """Quantiles by linear interpolation from counts ``n`` and running counts ``cum_n``."""
    totals = cumulated.groupBy(*keys).agg(F.sum("n").alias("_total"))
    rows = join_keys(cumulated, totals, list(keys), small=True)
    picks = []
    for name, q in points.items():
        at = (F.col("_total") - 1) * F.lit(q)
        for end, index in (("lo", F.floor(at)), ("hi", F.least(F.floor(at) + 1, F.col("_total") - 1))):
            inside = (F.col("cum_n") - F.col("n") <= index) & (index < F.col("cum_n"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{end}_{name}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_part_{name}"))
    found = rows.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (F.col(f"_lo_{p}") + F.col(f"_part_{p}") * (F.col(f"_hi_{p}") - F.col(f"_lo_{p}"))).alias(p)
            for p in points
        ],
    )


def describe(df: DataFrame, features: Sequence[str], digits: int = 3) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per feature."""
    measures = []
    for f in features:
        measures += [
            F.count(f).alias(f"n_{f}"),
            F.avg(f).alias(f"mean_{f}"),
            F.stddev_samp(f).alias(f"std_{f}"),
            F.min(F.col(f).cast("double")).alias(f"min_{f}"),
            F.max(F.col(f).cast("double")).alias(f"max_{f}"),
        ]
    moments = _rows_per_feature(
        df.agg(*measures), features, {"n_rows": "n", "mean": "mean", "std": "std", "min": "min", "max": "max"}
    )
    counts = value_counts(long_form(df, [], features).where("value is not null"), ["feature"])
    quarts = quantiles(prefix_sum(counts, ["feature"], "value", ["n"]), ["feature"], QUARTILES)
    joined = moments.join(quarts, "feature", "left")
    return joined.select(
        "feature", "n_rows", *[F.round(c, digits).alias(c) for c in ("mean", "std", "min", *QUARTILES, "max")]
    )


def class_means(df: DataFrame, label: str, features: Sequence[str], digits: int = 4) -> DataFrame:
    means = df.groupBy(label).agg(*[F.avg(f).alias(f"mean_{f}") for f in features])
    rows = _rows_per_feature(means, features, {"mean": "mean"}, [label])
    return rows.withColumn("mean", F.round("mean", digits))


def mid_ranks(df: DataFrame, features: Sequence[str], label: str | None = None, **kwargs) -> DataFrame:
    """Counts (``n``, with ``label`` also ``n_human`` and ``n_ai``) and average rank per distinct value."""
    rows = long_form(df, [label] if label else [], features)
    measures = [F.count(F.lit(1)).alias("n")]
    if label:
        measures += [F.count_if(F.col(label) == 0).alias("n_human"), F.count_if(F.col(label) == 1).alias("n_ai")]
    counts = rows.groupBy("feature", "value").agg(*measures)
    ranked = prefix_sum(counts, ["feature"], "value", ["n"], **kwargs)
    return ranked.withColumn("rank", F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0)


def _normal_p_value(u: Column, n1: Column, n2: Column, ties: Column) -> Column:
    """Two-sided p of U by the normal approximation, corrected for ties and continuity."""
    n = n1 + n2
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1))))
    larger = F.greatest(u, n1 * n2 - u)
    z = (larger - n1 * n2 / 2.0 - 0.5) / sigma
    return F.when(sigma > 0, F.least(erfc(z / math.sqrt(2.0)), F.lit(1.0))).otherwise(F.lit(1.0))


@lru_cache(maxsize=16)
def _numerator(small: int) -> tuple[int, list[int]]:
    """1 / ((1 - q) (1 - q^1) ... (1 - q^small)) as a polynomial over (1 - q^period)^(small + 1): (period, coefficients)."""
    period = math.lcm(*range(1, small + 1))
    out = [1] + [0] * ((small + 1) * period)
    for i in (1, *range(1, small + 1)):
        # Times (1 - q^period) / (1 - q^i): running sums at the distance i, less those a period before.
        for k in range(i, len(out)):
            out[k] += out[k - i]
        for k in range(len(out) - 1, period - 1, -1):
            out[k] -= out[k - period]
    return period, out


def count_up_to(most: int, small: int, big: int) -> int:
    """How many of the choose(small + big, small) orders of two samples without ties have U of at most ``most``.

    The Gaussian binomial counts orders by U. Its denominator and the sum over U only depend on the smaller sample; its
    numerator has few terms. So the count takes a few hundred steps in whole numbers however large the other sample is.
    """
    period, numerator = _numerator(small)
    terms = {(0, 0): 1}  # signs of the products of (1 - q^(big + i)), by number of factors and sum of their i
    for i in range(1, small + 1):
        for (n, shift), sign in list(terms.items()):
            terms[n + 1, shift + i] = terms.get((n + 1, shift + i), 0) - sign
    total = 0
    for (n, shift), sign in terms.items():
        left = most - n * big - shift
        if left >= 0:
            places = range(left % period, min(left, len(numerator) - 1) + 1, period)
            total += sign * sum(numerator[r] * math.comb((left - r) // period + small, small) for r in places)
    return total


@F.pandas_udf(DoubleType())
def _exact_p_value(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Two-sided p from the null distribution of U; only for one sample of at most 8 without ties."""

    def one(u: float, n1: int, n2: int) -> float:
        small, big = sorted((int(n1), int(n2)))
        larger = int(max(u, n1 * n2 - u))
        return min(1.0, float(Fraction(2 * count_up_to(small * big - larger, small, big), math.comb(small + big, small))))

    return pd.Series([one(*args) for args in zip(u, n1, n2)], dtype="float64")


def mann_whitney(
    df: DataFrame, label: str, features: Sequence[str], alpha: float = 0.05, exact: bool = True, n_tests: int | None = None
) -> DataFrame:
    """U of the human sample, p, rank-biserial effect and significance after Bonferroni, per feature.

    ``n_tests`` is the number of tests of the whole study, if only some of its features are given.
    """
    ranked = mid_ranks(df, features, label)
    n = F.col("n").cast("double")
    sums = ranked.groupBy("feature").agg(
        F.sum("n_human").cast("double").alias("n1"),
        F.sum("n_ai").cast("double").alias("n2"),
        F.sum(F.col("n_human") * F.col("rank")).alias("_rank_sum"),
        F.sum(n * n * n - n).alias("ties"),
        (F.sum(F.col("n_human") * F.col("value")) / F.sum("n_human")).alias("mean_human"),
        (F.sum(F.col("n_ai") * F.col("value")) / F.sum("n_ai")).alias("mean_ai"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    with_u = sums.withColumn("u", F.col("_rank_sum") - n1 * (n1 + 1) / 2.0)
    p = _normal_p_value(F.col("u"), n1, n2, F.col("ties"))
    if exact:
        # One row per feature reaches Python, and only samples of at most 8 are worked on there.
        few = (F.least(n1, n2) <= 8) & (F.col("ties") == 0)
        small_u = F.when(few, F.col("u")).otherwise(0.0)
        p = F.when(few, _exact_p_value(small_u, F.when(few, n1).otherwise(1.0), F.when(few, n2).otherwise(1.0))).otherwise(p)
    effect = F.round(F.abs(1.0 - 2.0 * F.col("u") / (n1 * n2)), 3)
    return with_u.withColumn("p_value", p).select(
        "feature",
        F.round("mean_human", 4).alias("mean_human"),
        F.round("mean_ai", 4).alias("mean_ai"),
        F.round("u", 1).alias("u"),
        "p_value",
        effect.alias("effect"),
        (F.col("p_value") < alpha / (n_tests or len(features))).alias("significant"),
    )


def effect_band(effect: Column) -> Column:
    return F.when(effect >= 0.5, "large").when(effect >= 0.3, "medium").when(effect >= 0.1, "small").otherwise("none")


def feature_ranking(tested: DataFrame, top: int = 8) -> DataFrame:
    """The features with the largest effects, banded."""
    return tested.withColumn("band", effect_band(F.col("effect"))).orderBy(F.desc("effect"), "feature").limit(top)


def significant_count(tested: DataFrame) -> DataFrame:
    return tested.agg(F.count_if("significant").alias("n_significant"), F.count(F.lit(1)).alias("n_features"))


def spearman_matrix(df: DataFrame, id_col: str, features: Sequence[str], hot_floor: int = 1000) -> DataFrame:
    """Rank correlation of every pair (feature_a after feature_b in the feature order)."""
    ranks = mid_ranks(df, features).select("feature", "value", "n", "rank")
    rows = long_form(df, [id_col], features)
    # A value with more than 1 in 2,000 rows would pile up in one task of the join: those ranks, at most
    # 2,000 per feature, are broadcast. All other values meet in an ordinary join.
    totals = ranks.groupBy("feature").agg(F.sum("n").alias("_total"))
    flagged = ranks.join(F.broadcast(totals), "feature").withColumn(
        "_hot", F.col("n") > F.greatest(F.col("_total") / 2000, F.lit(hot_floor))
    )
    hot = F.broadcast(flagged.where("_hot").select("feature", "value", "rank"))
    cold = flagged.where(~F.col("_hot")).select("feature", "value", "rank")
    on = ["feature", "value"]
    placed = rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(cold, on))
    wide = placed.groupBy(id_col).agg(*[F.max(F.when(F.col("feature") == f, F.col("rank"))).alias(f) for f in features])
    pairs = [(a, b) for i, a in enumerate(features) for b in features[:i]]
    corr = wide.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    entries = [
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"`{a}|{b}`").alias("rho"))
        for a, b in pairs
    ]
    return corr.select(F.inline(F.array(*entries)))


def box_summary(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Range and quartiles per feature and group."""
    group = [*keys, "feature"]
    counts = value_counts(long_form(df, keys, features), group)
    running = prefix_sum(counts, group, "value", ["n"])
    ends = running.groupBy(*group).agg(
        F.sum("n").alias("n_rows"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    return join_keys(ends, quantiles(running, group, QUARTILES), group).select(*group, "n_rows", "min", *QUARTILES, "max")


def probability_histogram(df: DataFrame, label: str, p: str, bins: int = 40) -> DataFrame:
    """Density in equal bins over each class's own range; empty bins included."""
    span = df.groupBy(label).agg(F.min(p).alias("_lo"), F.max(p).alias("_hi"), F.count(p).alias("_total"))
    # A class with a single value gets a unit range around it.
    flat = F.col("_lo") == F.col("_hi")
    span = span.select(
        label,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
        "_total",
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    placed = join_keys(df, span, [label], small=True).withColumn(
        "bin", F.least(F.floor((F.col(p) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    )
    counts = placed.groupBy(label, "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return join_keys(grid, counts, [label, "bin"], "left").select(
        label,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("lower"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / (F.col("_total") * width)).alias("density"),
    )


def kde_curve(df: DataFrame, label: str, p: str, points: int = 300) -> DataFrame:
    """Gaussian kernel density per class on an even grid over [0, 1], Scott bandwidth.

    Equal scores are merged first. Each score meets a constant array of grid points, and the sums are
    combined before the shuffle, so what moves is points x classes rows per task.
    """
    shape = df.groupBy(label).agg(F.count(p).alias("_n"), F.stddev_samp(p).alias("_std"))
    shape = shape.withColumn("_h", F.col("_std") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    scores = df.groupBy(label, p).agg(F.count(F.lit(1)).alias("_w"))
    scores = join_keys(scores, shape, [label], small=True)
    grid = F.array(*[F.lit(i / (points - 1)) for i in range(points)])
    spread = scores.select(label, p, "_w", "_n", "_h", F.posexplode(grid).alias("point", "x"))
    z = (F.col("x") - F.col(p)) / F.col("_h")
    return (
        spread.groupBy(label, "point", "x", "_n", "_h")
        .agg(F.sum(F.col("_w") * F.exp(-0.5 * z * z)).alias("_s"))
        .select(label, "point", "x", ratio(F.col("_s"), F.col("_n") * F.col("_h") * math.sqrt(2 * math.pi)).alias("density"))
    )
