"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a schedule: how strongly it is drawn at each moment of training. The weights fix
how many words each source gives in all (its target, at most ``max_epochs`` times its size; what it cannot take
is shared among the others). The integral of its schedule says how much of that is due by any moment. The
documents of a source stand one after another in a seeded order; the moment at which the demand reaches a
document, the inverse of that integral, is its training position. Documents are range-sorted by position.

Only DataFrame operations are used. Running sums inside a source go through buckets of the hash order, so that a
source with a third of all rows is summed in many tasks. Sources are counted by aggregation; what comes back to
the driver are single numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylotrace.llm.support import few, free_name, stored

# Weight and schedule of the first, second and third source in order of code points, then again from the start.
# A schedule is a list of (moment, strength); between the moments the strength is interpolated.
WEIGHTS = (5.0, 2.0, 1.0)
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.6, 0.75), (1.0, 2.125)),
)
ROWS_PER_BUCKET = 1 << 14
SOURCES_PER_TASK = 1 << 12


def word_count(text: Column) -> Column:
    """Number of runs of other characters than the six ASCII blanks; null has none."""
    lead = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+", "")
    return F.length(F.regexp_replace(lead, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w")).cast("long")


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """Add ``nth``, the place of each source in order of code points from 0, null last.

    Sources are sorted in ranges, so their number may grow with the corpus; only the counts of the ranges meet.
    """
    ranges = max(1, math.ceil(sizes.count() / SOURCES_PER_TASK))
    sorted_by = [F.col("source").isNull(), F.col("source")]
    parts = stored(
        sizes.repartitionByRange(ranges, *sorted_by).withColumn("part", F.spark_partition_id()), "sources"
    )
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy(*sorted_by)
    nth = F.col("first") + F.row_number().over(inside) - 1
    return parts.join(counts, "part").withColumn("nth", nth).drop("part", "first")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0
) -> DataFrame:
    """(source, source_size, nth, target) from (source, source_size).

    ``share`` of all sizes is divided by weight. Targets stop at ``max_epochs`` times the source's size; the
    excess goes to the others by weight until none is above. Each round is one aggregate of two numbers; a round
    caps at least one more source or is the last.
    """
    rows = stored(
        numbered_sources(sizes).select(
            "*",
            F.get(F.array(*map(F.lit, weights)), F.pmod("nth", F.lit(len(weights))).cast("int")).alias("weight"),
            (F.col("source_size") * float(max_epochs)).alias("ceiling"),
        ),
        "weights",
    )
    everything = (rows.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    per_weight = 0.0
    while True:
        full = F.col("weight") * per_weight >= F.col("ceiling")
        capped, open_weight = rows.agg(
            F.sum(F.when(full, F.col("ceiling")).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))
        ).first()
        if not open_weight:
            break
        following = (everything - capped) / open_weight
        if following <= per_weight:
            break
        per_weight = following
    target = F.least(F.col("ceiling"), F.col("weight") * per_weight)
    return rows.select("source", "source_size", "nth", target.alias("target"))


def _reached(fraction: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The moment by which ``fraction`` of a schedule's integral is reached.

    Strength is linear between two moments, so the integral is quadratic there and its inverse a square root.
    """
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False)]
    due, before, moment = fraction * sum(areas), 0.0, F.lit(schedule[-1][0])
    found = None
    for (t0, w0), (t1, w1), area in zip(schedule, schedule[1:], areas, strict=False):
        slope, y = (w1 - w0) / (t1 - t0), F.greatest(due - before, F.lit(0.0))
        step = y * 2 / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + y * (2 * slope), F.lit(0.0))))
        inside = F.least(F.lit(t0) + step, F.lit(t1))
        before += area
        found = F.when(due <= before, inside) if found is None else found.when(due <= before, inside)
    return found.otherwise(moment)


def plan(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    share: float = 1.5,
    max_epochs: int = 2,
    seed: int = 7,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, positions) for every row of (doc_id, source, text).

    ``positions`` lists the moments (0 to 1) at which the document is read, one for each pass; it is empty
    where the source needs less. The passes of a source end with the document whose middle lies before the
    target, so a source misses its target by half a document at most. Documents of size 0 are read in the first
    pass if its point is reached. Null sources form one source; rows that repeat an id are documents of their
    own. Reruns agree: the order is that of a seeded hash of the id.
    """
    rows = stored(
        docs.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))).alias("h"),
        ),
        "sizes",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, max_epochs)
    buckets = max(1, math.ceil(rows.count() / rows_per_bucket))
    start = F.conv(F.substring("h", 1, 8), 16, 10).cast("double")
    rows = rows.withColumn("bucket", F.floor(start * F.lit(buckets / (1 << 32))))
    # Totals by bucket: a source's running sum over them is as long as the number of buckets.
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("source").alias("s"),
        F.col("bucket").alias("b"),
        F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"),
    )
    totals = totals.join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size")
    rows = rows.withColumn("up_to", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    middle = F.col("offset") + F.col("up_to") - F.col("size") / 2
    positions = None
    for k, schedule in enumerate(schedules):
        points = F.array(*[
            F.when(middle + epoch * F.col("source_size") <= F.col("target"),
                   _reached((middle + epoch * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1e-9)), schedule))
            for epoch in range(max_epochs)
        ])
        chosen = F.pmod("nth", F.lit(len(schedules))) == k
        positions = F.when(chosen, points) if positions is None else positions.when(chosen, points)
    return rows.withColumn("positions", F.array_compact(positions)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("positions")).alias("taken"), "positions"
    )


def training_order(planned: DataFrame) -> DataFrame:
    """One row per pass over a document, range-sorted by ``position``."""
    return planned.select("*", F.explode("positions").alias("position")).orderBy("position", "doc_id")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as the mix reads them: dropped, once or repeated, range-sorted by position.

    Ids should be unique; rows that repeat an id are each read at all positions of that id.
    """
    own, places, place = (free_name(docs, n) for n in ("_id", "_positions", "_position"))
    chosen = plan(docs, **options).where(F.size("positions") > 0)
    chosen = chosen.groupBy("doc_id").agg(F.flatten(F.collect_list("positions")).alias(places))
    keyed = few(chosen.select(F.col("doc_id").alias(own), places))
    read = docs.join(keyed, F.col("doc_id").eqNullSafe(F.col(own))).select(
        *[docs[c] for c in docs.columns], F.explode(places).alias(place)
    )
    return read.orderBy(place, "doc_id").drop(place)
