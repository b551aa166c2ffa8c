"""Ranks and running sums that never sort a whole key in one task."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stylotrace.fixed_values import SEED
from stylotrace.session import materialise

HASH_PREFIX = 4  # hex digits: at most 65,536 buckets per key


def hash_key(id_col: str, seed: int = SEED) -> Column:
    """Seeded pseudo-random sort key of a row: md5 of ``seed:id``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def hash_rank(
    df: DataFrame, id_col: str, keys: Sequence[str], seed: int = SEED, limit: Column | None = None
) -> DataFrame:
    """Add ``_rank`` (1..n in hash order) and ``_total`` per combination of ``keys``.

    Rows are counted per hash prefix first. The running sum of those counts (at most 65,536 rows per
    key) gives every prefix its offset, so that sorting happens inside one prefix bucket only. ``keys``
    are labels with few values; a null key is a group of its own, and rows with a null id are ranked too
    (all in one bucket, so there should be few). With ``limit`` (an expression over ``_total``) only the rows ranked
    within it are kept, and buckets beyond it are dropped before any shuffle.
    """
    keyed = df.withColumn("_h", hash_key(id_col, seed))
    keyed = keyed.withColumn("_b", F.substring("_h", 1, HASH_PREFIX))
    group = list(keys) or [F.lit(1)]
    by_key = Window.partitionBy(*group)
    ordered = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = (
        keyed.groupBy(*keys, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.sum("_n").over(ordered) - F.col("_n"))
        .withColumn("_total", F.sum("_n").over(by_key))
    )
    if limit is not None:
        hist = hist.where(F.col("_offset") < limit)
    hist = hist.drop("_n").withColumnsRenamed({c: f"_at_{c}" for c in [*keys, "_b"]})
    in_bucket = Window.partitionBy(*keys, "_b").orderBy("_h", id_col)
    # The histogram is bounded by prefixes times labels, so it may be broadcast.
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in [*keys, "_b"]])
    ranked = keyed.join(F.broadcast(hist), same).withColumn("_rank", F.col("_offset") + F.row_number().over(in_bucket))
    if limit is not None:
        ranked = ranked.where(F.col("_rank") <= limit)
    return ranked.drop("_h", "_b", "_offset", *[f"_at_{c}" for c in [*keys, "_b"]])


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on ``keys`` with null as a key like any other. ``small``: the right side has one row per label."""
    renamed = right.withColumnsRenamed({c: f"_at_{c}" for c in keys})
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in keys])
    return left.join(F.broadcast(renamed) if small else renamed, same, how).drop(*[f"_at_{c}" for c in keys])


def prefix_sum(
    counts: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    descending: bool = False,
    following: Sequence[str] = (),
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Add ``cum_<c>``, the inclusive running sum of each column in ``sums`` per key in value order.

    ``counts`` has one row per (keys, order value), which also defuses hot values: they are one row each. A null key is
    a group of its own. ``following`` adds ``next_<c>``, the value of ``c`` in the next row.

    The rows are range-partitioned by key and value, so no range is larger than a partition even if one key holds all
    rows. Sums run inside the ranges; only the totals of the ranges, one row for each and one more per key, meet in
    order and give every range its offset. Spark chooses the number of ranges by ``spark.sql.shuffle.partitions`` and the
    size of the rows, unless ``rows_per_bucket`` asks for a certain size. The result does not depend on it.
    """
    keys = list(keys)
    if not keys:
        alone = prefix_sum(
            counts.withColumn("_all", F.lit(0)), ["_all"], order, sums, descending, following, rows_per_bucket
        )
        return alone.drop("_all")
    columns = counts.columns
    by = [*keys, order]
    if rows_per_bucket is None:
        ranged = counts.repartitionByRange(*by)
    else:
        counts = materialise(counts)
        ranged = counts.repartitionByRange(max(1, math.ceil(counts.count() / rows_per_bucket)), *by)
    ranged = materialise(ranged.withColumn("_range", F.spark_partition_id()))

    direction = F.col(order).desc() if descending else F.col(order).asc()
    ranges = F.col("_range").desc() if descending else F.col("_range").asc()
    running = (Window.unboundedPreceding, Window.currentRow)
    first = F.max if descending else F.min  # nulls are smallest in structs as they are in the sort
    totals = ranged.groupBy(*keys, "_range").agg(
        *[F.sum(c).alias(f"_sum_{c}") for c in sums],
        *[first(F.struct(F.col(order), F.col(c)))[c].alias(f"_first_{c}") for c in following],
    )
    across = Window.partitionBy(*keys).orderBy(ranges)  # one row per range
    totals = totals.select(
        *keys,
        "_range",
        *[(F.sum(f"_sum_{c}").over(across.rowsBetween(*running)) - F.col(f"_sum_{c}")).alias(f"_off_{c}") for c in sums],
        *[F.lead(f"_first_{c}").over(across).alias(f"_after_{c}") for c in following],
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(direction)
    out = join_keys(ranged, totals, [*keys, "_range"])
    out = out.withColumns({f"cum_{c}": F.col(f"_off_{c}") + F.sum(c).over(inside.rowsBetween(*running)) for c in sums})
    if following:
        ends = F.lead(F.lit(1)).over(inside).isNull()
        out = out.withColumns(
            {f"next_{c}": F.when(ends, F.col(f"_after_{c}")).otherwise(F.lead(c).over(inside)) for c in following}
        )
    return out.select(*columns, *[f"cum_{c}" for c in sums], *[f"next_{c}" for c in following])


def long_form(df: DataFrame, id_cols: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per (row, feature) with columns ``feature`` and ``value``."""
    doubles = df.select(*id_cols, *[F.col(f).cast(T.DoubleType()).alias(f) for f in features])
    return doubles.unpivot(list(id_cols), list(features), "feature", "value")
