"""Exact deduplication against brute force, and the filters against sets."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from stylotrace.llm import exact


def test_filters_have_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 10, 1000, 30_000):
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        built = exact.build_filter(np.concatenate([keys, keys[: n // 2]]))
        assert exact.may_contain(keys, *built).all()
        others = rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
        assert exact.may_contain(others, *built).mean() < 0.02
    assert len(built[3]) < 1.5 * 30_000


def brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        plain = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(plain, []).append((-len(t or ""), i is None, i or 0, k, i))
    out = []
    for plain, members in groups.items():
        best = min(members)
        sha = hashlib.sha256(plain.encode()).hexdigest()
        out += [(m[4], best[4], len(members), m is best, sha) for m in members]
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    texts = ["a b", "ab", "a  b", None, "", " \n", "é à", "éà", "x" * 70_000, "x" * 69_999 + " x", " ", "once"]
    rows = [(i, texts[i % len(texts)] if i % 3 else f"t{i % 40}") for i in range(400)] + [(None, "ab"), (None, "lost")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = exact.exact_dedup(df, exact.half_of_ids(), digests_per_filter=16).drop("n_points")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_everything_old_or_everything_new(spark):
    rows = [(i, f"t{i % 7}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for incoming in (F.lit(True), F.lit(False)):
        assert sorted(map(tuple, exact.exact_dedup(df, incoming).drop("n_points").collect()), key=repr) == brute(rows)
    assert exact.exact_dedup(df.limit(0), exact.half_of_ids()).count() == 0


def test_repeated_rows_keep_one(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (1, "ab", "y"), (2, "c", None), (None, "c", "z"), (None, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, copies string")
    assert exact.exact_dedup(df, exact.half_of_ids()).where("kept").count() == 3
    kept = exact.drop_copies(df, exact.half_of_ids())
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == [(1, "a b", "x"), (2, "c", None), (None, None, "n")]
