"""Exact deduplication of an incoming batch against immutable snapshots.

A snapshot holds one row per distinct normalised text (its bucket) and static binary fuse filters over 64-bit
digests of these texts, one filter per range of digests. Texts of a new batch are first grouped among
themselves. One row per group is screened by the filters; what passes joins the exact buckets and is checked by
length and 256-bit digest of the normalised bytes, so neither a false positive of a filter nor a collision of
the short digests counts as a copy. Only narrow rows move; a text never does.

A group of copies of any size is combined by partial aggregation before it is shuffled. The final join from
rows to groups has one row on the group side, which adaptive execution splits where a group is hot.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylotrace.llm.support import few, free_name, one_of_repeats, stored, without_blanks

DIGESTS_PER_FILTER = 1 << 14
TEXT_KEY = ["short", "text_sha256", "n_bytes"]
FILTER_SCHEMA = "bucket int, seed long, segment int, segments int, fingerprints binary"


# Binary fuse filters ---------------------------------------------------------------------------


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> tuple[np.ndarray, ...]:
    """Three slots in consecutive segments for each hash."""
    first = ((h >> np.uint64(32)) * np.uint64(segment * segments)) >> np.uint64(32)
    mask, step = np.uint64(segment - 1), np.uint64(segment)
    second = (first + step) ^ ((h >> np.uint64(18)) & mask)
    third = (first + step + step) ^ (h & mask)
    return first.astype(np.int64), second.astype(np.int64), third.astype(np.int64)


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(40))).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Seed, segment length, number of first segments and fingerprints of a filter over 64-bit keys."""
    keys = np.unique(keys.astype(np.uint64))
    n = max(len(keys), 2)
    segment = 1 << max(2, min(18, int(math.log(n) / math.log(3.33) + 2.25)))
    wanted = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    segments = max(1, math.ceil(wanted / segment) - 2)
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
        slots = np.stack(_slots(h, segment, segments))
        order = _peel(slots, (segments + 2) * segment)
        if order is not None:
            table = np.zeros((segments + 2) * segment, np.uint8)
            marks = _fingerprint(h)
            for who, where in reversed(order):
                a, b, c = slots[:, who]
                table[where] = 0
                table[where] = marks[who] ^ table[a] ^ table[b] ^ table[c]
            return seed, segment, segments, table.tobytes()
        if seed % 20 == 0:
            segments += 1 + segments // 10
    raise RuntimeError("no filter found")


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, slots that only they use), or None if some keys cannot be told apart."""
    n = slots.shape[1]
    count = np.bincount(slots.ravel(), minlength=size)
    held = np.zeros(size, np.int64)
    for row in slots:
        np.bitwise_xor.at(held, row, np.arange(n))
    rounds, done, alone = [], 0, np.flatnonzero(count == 1)
    while len(alone):
        who, at = np.unique(held[alone], return_index=True)
        rounds.append((who, alone[at]))
        done += len(who)
        touched = slots[:, who]
        for row in touched:
            np.subtract.at(count, row, 1)
            np.bitwise_xor.at(held, row, who)
        touched = np.unique(touched)
        alone = touched[count[touched] == 1]
    return rounds if done == n else None


def may_contain(keys: np.ndarray, seed: int, segment: int, segments: int, fingerprints: bytes) -> np.ndarray:
    table = np.frombuffer(fingerprints, np.uint8)
    h = _mix(keys.astype(np.uint64), seed * 0x9E3779B97F4A7C15 % (1 << 64))
    a, b, c = _slots(h, segment, segments)
    return _fingerprint(h) == table[a] ^ table[b] ^ table[c]


# Snapshots -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Snapshot:
    """Exact buckets (one row per distinct text) and the filters over their short digests."""

    buckets: DataFrame
    filters: DataFrame
    n_filters: int


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A narrow stored row per document: id, row number, short and full digest, bytes and code points."""
    plain = without_blanks(F.col(text))
    return stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.monotonically_increasing_id().alias("row_no"),
            F.xxhash64(plain).alias("short"),
            F.sha2(plain, 256).alias("text_sha256"),
            F.octet_length(plain).alias("n_bytes"),
            F.coalesce(F.char_length(text), F.lit(0)).alias("n_points"),
        ),
        "digests",
    )


def group_copies(rows: DataFrame) -> DataFrame:
    """One row per distinct text: number of copies and the best row.

    The best row has the most code points, then the smallest id (null last); among repeated rows of one id
    the first.
    """
    best = F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("n"), "doc_id", "row_no")
    return rows.groupBy(*TEXT_KEY).agg(
        F.count(F.lit(1)).alias("copies"), F.min(best).alias("best")
    )


def _bucket(n_filters: int) -> Column:
    return F.pmod(F.shiftrightunsigned("short", 20), F.lit(n_filters)).cast("int")


def build_snapshot(rows: DataFrame, digests_per_filter: int = DIGESTS_PER_FILTER) -> Snapshot:
    """Store the buckets of ``rows`` (see ``digest_rows``) and filters of bounded size over them."""
    buckets = stored(group_copies(rows), "buckets")
    n_filters = max(1, math.ceil(buckets.count() / digests_per_filter))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        seed, segment, segments, marks = build_filter(table.column("short").to_numpy().view(np.uint64))
        row = {"bucket": key[0].as_py(), "seed": seed, "segment": segment, "segments": segments}
        schema = pa.schema(
            [("bucket", pa.int32()), ("seed", pa.int64()), ("segment", pa.int32()), ("segments", pa.int32())]
            + [("fingerprints", pa.binary())]
        )
        return pa.Table.from_pylist([row | {"fingerprints": marks}], schema)

    digests = buckets.select(_bucket(n_filters).alias("bucket"), "short")
    filters = digests.groupBy("bucket").applyInArrow(build, FILTER_SCHEMA)
    return Snapshot(buckets, stored(filters, "filters"), n_filters)


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The short digests of ``groups`` that a filter of the snapshot lets pass: all real ones, few others."""
    asked = groups.select(_bucket(snapshot.n_filters).alias("bucket"), "short")

    def test(asked: pa.Table, filters: pa.Table) -> pa.Table:
        out = asked.select(["short"])
        if not filters.num_rows:
            return out.slice(0, 0)
        f = filters.to_pylist()[0]
        keys = out.column("short").to_numpy().view(np.uint64)
        return out.filter(pa.array(may_contain(keys, f["seed"], f["segment"], f["segments"], f["fingerprints"])))

    return asked.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInArrow(test, "short long")


def ingest(rows: DataFrame, snapshots: Sequence[Snapshot]) -> DataFrame:
    """Groups of copies over snapshots and a new batch: (short, text_sha256, n_bytes, copies, best), one per text.

    The snapshots hold different texts, as each was ingested against the earlier ones. A group of the batch
    that no filter lets pass is new; one that passes is looked up in the exact buckets.
    """
    new = stored(group_copies(rows), "batch")
    hits = []
    for snapshot in snapshots:
        candidates = new.join(screen(new, snapshot), "short", "left_semi")
        old = snapshot.buckets.withColumnsRenamed({"copies": "old_copies", "best": "old_best"})
        hits.append(stored(candidates.join(old, TEXT_KEY), "hits"))
    groups = new
    for hit in hits:
        groups = groups.join(hit, TEXT_KEY, "left_anti")
    for snapshot, hit in zip(snapshots, hits, strict=True):
        added = hit.select(*TEXT_KEY, F.col("copies").alias("more"), F.col("best").alias("other"))
        joined = snapshot.buckets.join(added, TEXT_KEY, "left").select(
            *TEXT_KEY,
            (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"),
            F.least("best", "other").alias("best"),
        )
        groups = groups.unionByName(joined)
    return groups


def exact_dedup(docs: DataFrame, incoming: Column, digests_per_filter: int = DIGESTS_PER_FILTER) -> DataFrame:
    """Every row with its group: rows where ``incoming`` (over doc_id) holds are the batch, the others the snapshot.

    Returns (doc_id, keep_id, group_size, kept, text_sha256, n_points). Null and blank texts are equal
    to each other. A null doc_id comes last when ids decide; of rows that repeat an id and a text one is kept.
    """
    rows = digest_rows(docs).withColumn("incoming", F.coalesce(incoming, F.lit(True)))
    snapshot = build_snapshot(rows.where(~F.col("incoming")), digests_per_filter)
    groups = ingest(rows.where("incoming"), [snapshot])
    found = groups.select("text_sha256", "n_bytes", F.col("copies").alias("group_size"), "best")
    return rows.join(found, ["text_sha256", "n_bytes"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("best.row_no")).alias("kept"),
        "text_sha256",
        "n_points",
    )


def half_of_ids() -> Column:
    """A repeatable half of the documents plays the incoming batch."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 1


def drop_copies(docs: DataFrame, incoming: Column) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of wholly repeated rows one."""
    own, sha, points = (free_name(docs, n) for n in ("_id", "_sha", "_n"))
    found = stored(exact_dedup(docs, incoming).select("doc_id", "text_sha256", "n_points", "kept"), "verdicts")
    texts = found.groupBy("doc_id", "text_sha256", "n_points").agg(F.bool_or("kept").alias("kept"))
    gone = few(texts.where(~F.col("kept")).select(F.col("doc_id").alias(own), F.col("text_sha256").alias(sha), F.col("n_points").alias(points)))
    match = (
        F.col("doc_id").eqNullSafe(F.col(own))
        & (F.sha2(without_blanks(F.col("text")), 256) == F.col(sha))
        & (F.coalesce(F.char_length("text"), F.lit(0)) == F.col(points))
    )
    # Copies are named, not what stays: texts only move if the copies are too many to be broadcast.
    repeats = found.groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id").distinct()
    return one_of_repeats(docs.join(gone, match, "left_anti"), repeats)
