"""Tree attribution against all feature subsets, and its sums."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylotrace.operators import attribution, models

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(160):
        x = rng.normal(size=4).round(2)
        data.append((i, int(x[0] + x[1] * x[2] > 0.1 * rng.normal()), *map(float, x)))
    return spark.createDataFrame(data, "doc_id long, y int, a double, b double, c double, d double").repartition(3)


@pytest.fixture(scope="module")
def forest(rows):
    from pyspark.ml.feature import VectorAssembler

    preset = {"trees": 5, "depth": 6, "leaf": 1, "balanced": False}
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    return models.random_forest(preset).fit(ready)


def expectation(nodes, at, x, known):
    """The value of a tree if only some features are known: unknown splits are averaged by training weight."""
    node = nodes[at]
    if node["left"] < 0:
        return node["p"]
    children = [nodes[node[s]] for s in ("left", "right")]
    if node["feature"] in known:
        return expectation(nodes, node["left" if x[node["feature"]] <= node["threshold"] else "right"], x, known)
    return sum(c["weight"] / node["weight"] * expectation(nodes, c["id"], x, known) for c in children)


def by_subsets(trees, x):
    d, out = len(x), np.zeros(len(x))
    worth = {}
    for size in range(d + 1):
        for known in itertools.combinations(range(d), size):
            worth[known] = np.mean([expectation(t, 0, x, known) for t in trees])
    for known, value in worth.items():
        for f in set(range(d)) - set(known):
            share = math.factorial(len(known)) * math.factorial(d - len(known) - 1) / math.factorial(d)
            out[f] += share * (worth[tuple(sorted((*known, f)))] - value)
    return out, worth[()], worth[tuple(range(d))]


@pytest.mark.parametrize("cells", [1 << 22, 40])
def test_equals_the_sum_over_all_subsets(spark, rows, forest, monkeypatch, cells):
    monkeypatch.setattr(attribution, "CELLS_PER_PIECE", cells)  # 40: each tree is a piece of its own
    monkeypatch.setattr(attribution, "CELLS_AT_ONCE", 500)
    trees = {}
    for r in attribution.node_table(forest).collect():
        trees.setdefault(r["tree"], {})[r["id"]] = r.asDict()
    some = rows.where("doc_id < 12")
    got = {(r.doc_id, r.feature): r for r in attribution.tree_attribution(some, forest, FEATURES).collect()}
    assert len(got) == 48
    for r in some.collect():
        want, base, p = by_subsets(list(trees.values()), [r[f] for f in FEATURES])
        for f, value in zip(FEATURES, want):
            found = got[r.doc_id, f]
            assert (found.contribution, found.base, found.p) == pytest.approx((value, base, p), abs=1e-12)


def test_sums_and_probabilities_of_all_rows(rows, forest):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    p = {r.doc_id: r.p for r in forest.transform(ready).select("doc_id", vector_to_array("probability")[1].alias("p")).collect()}
    found = attribution.tree_attribution(rows.unionByName(rows.where("doc_id = 3")), forest, FEATURES)
    sums = found.groupBy("doc_id").agg(F.sum("contribution").alias("c"), F.count("*").alias("n"), F.max("base").alias("base"), F.max("p").alias("p"))
    sums = sums.collect()
    assert len(sums) == 160
    for r in sums:
        assert r.p == pytest.approx(p[r.doc_id], abs=1e-12)
        assert r.c / (r.n / 4) + r.base == pytest.approx(r.p, abs=1e-12)


def test_trees_without_splits_and_no_rows(spark, forest, rows):
    leaves = attribution.Leaves([{"value": 0.25, "feature": [], "low": [], "high": [], "share": []}])
    out, value = attribution.leaf_attribution(np.zeros((3, 2)), leaves)
    assert not out.any() and value.tolist() == [0.25] * 3
    assert attribution.tree_attribution(rows.limit(0), forest, FEATURES).count() == 0
