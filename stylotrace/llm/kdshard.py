"""Sharding by a k-d tree over metadata.

A node holds a range of shards and splits it in two halves at the weighted quantile that gives each half its
share of the bytes, along the dimension in which its documents spread widest. All nodes of a level are split
together. A quantile is found by histograms over narrow rows: one over the node's range, then over the bin in which
the quantile falls until that is a single coordinate, and, for the documents there, one over a hash of the id. What comes
back to the driver are as many rows as there are nodes.

Coordinates end in a digest of the text, so equal texts lie together; a group of copies that is larger than a shard
is split by the last histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylotrace.llm.support import stored

BINS = 1 << 16
HASH_BINS = 1 << 16
SLOT_BUCKETS = 64
OVERHEAD = 16


def document_sizes(docs: DataFrame) -> DataFrame:
    """Stored narrow rows: doc_id, size, text_crc32 and the coordinates.

    The dimensions are the size (logarithm), the language (in its alphabetical place, roughly) and the digest.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    digest = F.col("text_crc32")
    name = F.rpad(F.coalesce(F.col("lang"), F.lit("")), 2, " ")
    place = F.ascii(name) * 256 + F.ascii(F.substring(name, 2, 1))
    rows = docs.select("doc_id", "lang", (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    magnitude = F.floor(F.log2("size") * 1024).cast("long")
    coordinates = [F.shiftleft(magnitude, 32) + digest, F.shiftleft(place.cast("long"), 32) + digest, digest]
    h = F.pmod(F.xxhash64("doc_id"), F.lit(HASH_BINS)).cast("int")
    return stored(rows.select("doc_id", "size", "text_crc32", F.array(*coordinates).alias("at"), h.alias("h")), "sizes")


def _cuts(rows: DataFrame, bin_: Column, targets: DataFrame) -> dict[int, tuple[int, float]]:
    """Per node the bin in which the running sum of sizes passes its target, and the sum before that bin."""
    histogram = rows.groupBy("node", bin_.alias("bin")).agg(F.sum("size").alias("bytes"))  # nodes x bins rows
    upto = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = histogram.withColumn("upto", F.sum("bytes").over(upto)).join(F.broadcast(targets), "node")
    passed = summed.where(F.col("upto") >= F.col("target"))
    first = passed.groupBy("node").agg(F.min(F.struct("bin", (F.col("upto") - F.col("bytes")).alias("before"))).alias("cut"))
    return {r.node: (r.cut.bin, float(r.cut.before)) for r in first.collect()}


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int = 256 << 20) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of (doc_id, text, lang); shards have near equal bytes.

    ``shards`` fixes their number; else leaves are split until they hold about ``target_bytes``. Slots number the
    documents of a shard from 0 without gaps. Null texts have no bytes; null ids, null languages, ties and
    repeated rows are documents like others. Reruns agree.
    """
    rows = document_sizes(docs).withColumn("node", F.lit(0))
    spark, dims = docs.sparkSession, range(3)
    if shards is None:
        shards = max(1, round((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    width = {0: shards}  # shards of each node; a node is named by its first shard
    spans = None
    while any(n > 1 for n in width.values()):
        stats = rows.groupBy("node").agg(
            F.sum("size").alias("bytes"),
            *[F.min(F.get("at", F.lit(d))).alias(f"lo{d}") for d in dims],
            *[F.max(F.get("at", F.lit(d))).alias(f"hi{d}") for d in dims],
        )
        found = {r.node: r for r in stats.collect()}  # one row per node, at most as many as shards
        spans = spans or [max((found[0][f"hi{d}"] - found[0][f"lo{d}"]) if found else 0, 1) for d in dims]
        open_ = {}
        for node, n in width.items():
            if n > 1 and node in found:
                r = found[node]
                d = max(dims, key=lambda d: (r[f"hi{d}"] - r[f"lo{d}"]) / spans[d])  # noqa: B023
                open_[node] = [d, r[f"lo{d}"], r[f"hi{d}"] + 1, r["bytes"] * (n // 2) / n, 0]
        for node, n in list(width.items()):
            if n > 1:
                width[node], width[node + n // 2] = n // 2, n - n // 2
        if not open_:
            continue

        def state() -> DataFrame:
            values = [(node, v[1], v[2], -(-(v[2] - v[1]) // BINS), float(v[3]), v[0], v[4]) for node, v in open_.items()]  # noqa: B023
            return spark.createDataFrame(values, "node int, lo long, hi long, step long, target double, dim int, cut int")

        while any(v[2] - v[1] > 1 for v in open_.values()):  # three times at most: coordinates have 48 bits
            x = F.get("at", F.col("dim"))
            inside = rows.join(F.broadcast(state()), "node").where((x >= F.col("lo")) & (x < F.col("hi")))
            bin_ = F.expr("(at[dim] - lo) DIV step")
            cuts = _cuts(inside.drop("target"), bin_, state().select("node", "target"))
            for node, (b, before) in cuts.items():
                v = open_[node]
                step = -(-(v[2] - v[1]) // BINS)
                v[1], v[2], v[3] = v[1] + step * b, min(v[1] + step * (b + 1), v[2]), v[3] - before
        x = F.get("at", F.col("dim"))
        inside = rows.join(F.broadcast(state()), "node").where((x >= F.col("lo")) & (x < F.col("hi")))
        for node, (b, _) in _cuts(inside.drop("target"), F.col("h"), state().select("node", "target")).items():
            open_[node][4] = b
        here = rows.join(F.broadcast(state()), "node", "left")
        # Columns of the state are null where a node is finished.
        right = (x >= F.col("hi")) | ((x >= F.col("lo")) & (F.col("h") > F.col("cut")))
        step = spark.createDataFrame([(node, width[node]) for node in open_], "node int, left_shards int")
        moved = F.when(F.coalesce(right, F.lit(False)), F.col("node") + F.col("left_shards")).otherwise(F.col("node"))
        here = here.join(F.broadcast(step), "node", "left").withColumn("node", moved.cast("int"))
        rows = stored(here.select("doc_id", "size", "text_crc32", "at", "h", "node"), "nodes")
    # Slots: buckets of the id's hash get offsets, so no shard is numbered in one task.
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(SLOT_BUCKETS)))
    counts = rows.groupBy("node", "bucket").count()  # shards x SLOT_BUCKETS rows
    before = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("node", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("node", "bucket").orderBy("h", "doc_id", "text_crc32", "size"))
    numbered = rows.withColumn("nth", nth).join(counts, ["node", "bucket"])
    slot = (F.col("offset") + F.col("nth") - 1).cast("long")
    return numbered.select("doc_id", "size", "text_crc32", F.col("node").alias("shard"), slot.alias("slot"))
