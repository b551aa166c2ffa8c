import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stylotrace.operators.ordering import hash_rank, prefix_sum
from stylotrace.operators.sampling import balanced_sample, sample_per_class, shuffle_with_ids, stratified_kfold, stratified_split, with_class_weights


def md5(i):
    return hashlib.md5(f"42:{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, i % 3 == 0) for i in range(500)]
    return spark.createDataFrame(data, "id long, label boolean")


def test_hash_rank_equals_sorting(rows):
    got = {r["id"]: (r["_rank"], r["_total"]) for r in hash_rank(rows, "id", ["label"]).collect()}
    for label in (True, False):
        ids = sorted((i for i in range(500) if (i % 3 == 0) == label), key=md5)
        assert [got[i] for i in ids] == [(n + 1, len(ids)) for n in range(len(ids))]


def test_hash_rank_limit_keeps_the_first(rows):
    kept = {r["id"] for r in hash_rank(rows, "id", [], limit=F.lit(37)).collect()}
    assert kept == set(sorted(range(500), key=md5)[:37])


def test_samples_and_splits(rows):
    assert {r["label"]: r["count"] for r in sample_per_class(rows, "id", "label", 200).groupBy("label").count().collect()} == {True: 167, False: 200}
    assert {r["count"] for r in balanced_sample(rows, "id", "label", 1000).groupBy("label").count().collect()} == {167}
    ids = [r["new"] for r in shuffle_with_ids(rows, "id", out="new").collect()]
    assert sorted(ids) == list(range(500))
    split = stratified_split(rows, "id", "label").groupBy("label", "split").count().collect()
    assert {(r["label"], r["split"]): r["count"] for r in split} == {
        (True, "test"): 33, (True, "train"): 134, (False, "test"): 67, (False, "train"): 266,
    }
    folds = stratified_kfold(rows, "id", "label").groupBy("label", "fold").count().collect()
    sizes = [r["count"] for r in folds if r["label"]]
    assert len(folds) == 10 and max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_results_do_not_depend_on_partitions(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    expected = sorted(map(tuple, stratified_split(rows, "id", "label").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert sorted(map(tuple, stratified_split(rows.repartition(7), "id", "label").collect())) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("per_bucket", [1_000_000, 50])
def test_prefix_sum(spark, descending, per_bucket):
    rng = random.Random(1)
    data = {}
    for key, n in (("a", 700), ("b", 41), ("c", 1)):
        for _ in range(n):
            data[key, round(rng.gauss(0, 3), 2)] = rng.randint(1, 9)
    table = spark.createDataFrame([(k, v, n) for (k, v), n in data.items()], "k string, v double, n long")
    got = prefix_sum(table, ["k"], "v", ["n"], descending, following=["n"], rows_per_bucket=per_bucket)
    found = {(r["k"], r["v"]): (r["cum_n"], r["next_n"]) for r in got.collect()}
    assert len(found) == len(data)
    for key in "abc":
        values = sorted((v for k, v in data if k == key), reverse=descending)
        total = 0
        for i, v in enumerate(values):
            total += data[key, v]
            following = data[key, values[i + 1]] if i + 1 < len(values) else None
            assert found[key, v] == (total, following)


def test_prefix_sum_without_keys(spark):
    table = spark.createDataFrame([(float(i), 1) for i in range(100)], "v double, n long")
    got = prefix_sum(table, [], "v", ["n"], rows_per_bucket=10)
    assert got.columns == ["v", "n", "cum_n"]
    assert sorted((r["v"], r["cum_n"]) for r in got.collect()) == [(float(i), i + 1) for i in range(100)]


def test_null_labels_and_ids_are_kept(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "a"), (None, None), (5, None)], "id long, label string")
    ranked = hash_rank(rows, "id", ["label"])
    assert ranked.columns == ["id", "label", "_total", "_rank"]
    got = sorted((r["label"] or "", r["_rank"], r["_total"]) for r in ranked.collect())
    assert got == [("", 1, 3), ("", 2, 3), ("", 3, 3), ("a", 1, 2), ("a", 2, 2)]
    for drawn in (stratified_split(rows, "id", "label"), stratified_kfold(rows, "id", "label"), shuffle_with_ids(rows, "id", out="n")):
        assert drawn.count() == 5
    weights = {r["label"]: r["weight"] for r in with_class_weights(rows, "label").collect()}
    assert weights == {"a": 5 / 4, None: 5 / 6}


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sum_with_null_keys_and_values_at_any_number_of_ranges(spark, descending):
    rng = random.Random(2)
    data = {(k, None if v == 13 else v): rng.randint(1, 9) for k in ("a", None, "b") for v in range(200) if rng.random() < 0.6}
    table = spark.createDataFrame([(k, v, n, None if n == 4 else n) for (k, v), n in data.items()], "k string, v int, n long, m long")
    results = []
    for per_bucket in (None, 1_000_000, 7, 1):
        got = prefix_sum(table, ["k"], "v", ["n"], descending, following=["m"], rows_per_bucket=per_bucket)
        results.append(sorted(map(tuple, got.collect()), key=repr))
    assert results[1:] == results[:1] * 3 and len(results[0]) == len(data)
    place = lambda v: (v is not None, v or 0)  # noqa: E731  null is the smallest
    found = {(r[0], r[1]): r[4:] for r in results[0]}
    for key in ("a", None, "b"):
        values, total = sorted((v for k, v in data if k == key), key=place, reverse=descending), 0
        for i, v in enumerate(values):
            total += data[key, v]
            after = data[key, values[i + 1]] if i + 1 < len(values) else None
            assert found[key, v] == (total, None if after == 4 else after)


def test_summaries_and_curves_keep_null_groups(spark):
    from stylotrace.operators.evaluate import pr_curve, roc_curve
    from stylotrace.operators.stats import box_summary

    rows = spark.createDataFrame([(None, float(i), i % 2) for i in range(5)] + [("x", float(i), i % 3 % 2) for i in range(9)], "g string, v double, y int")
    found = {r["g"]: (r["n_rows"], r["q50"]) for r in box_summary(rows, ["g"], ["v"]).collect()}
    assert found == {None: (5, 2.0), "x": (9, 4.0)}
    scored = rows.withColumn("p", F.col("v") / 10)
    for curve in (roc_curve, pr_curve):
        points = curve(scored, ["g"]).groupBy("g").count().collect()
        assert {r["g"] for r in points} == {None, "x"} and min(r["count"] for r in points) > 2
