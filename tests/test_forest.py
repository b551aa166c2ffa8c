"""Forests grown in parts, against trees grown whole and by brute force."""

import pickle

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from stylotrace.operators import forest

PRESET = {"trees": 6, "depth": None, "leaf": 2, "balanced": True}


def table(spark, n=600, d=5, sparse=False):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        x = rng.normal(size=d).round(2) * (rng.random(d) < (0.3 if sparse else 1))
        y = int(x[0] + x[1] * x[2] > 0.3 * rng.normal())
        v = Vectors.sparse(d, {int(f): float(x[f]) for f in np.flatnonzero(x)}) if sparse else Vectors.dense(x)
        rows.append((i, y, 0.75 if y else 1.5, v))
    data = spark.createDataFrame(rows, ["doc_id", "y", "weight", "features"]).withColumn("y", F.col("y").cast("int"))
    return data.repartition(3, "doc_id").cache()


def walk(nodes, x):
    at = 1
    while nodes[at]["feature"] >= 0:
        at = nodes[at]["left" if x[nodes[at]["feature"]] <= nodes[at]["threshold"] else "right"]
    return at


@pytest.mark.parametrize("rows_in_group", [1 << 17, 50])
@pytest.mark.parametrize("sparse", [False, True])
def test_probabilities_and_weights_follow_from_the_nodes(spark, monkeypatch, rows_in_group, sparse):
    """With 50 rows a group most splits are made over the whole table, by jobs; every node adds up to its children."""
    monkeypatch.setattr(forest, "ROWS_IN_GROUP", rows_in_group)
    monkeypatch.setattr(forest, "DENSE", 4 if sparse else 256)
    monkeypatch.setattr(forest, "NODES_PER_PIECE", 100)
    data = table(spark, sparse=sparse)
    model = forest.fit_forest(data, PRESET, 30, 42)
    trees = [{} for _ in range(6)]
    for r in model.nodes.collect():
        assert r["id"] not in trees[r["tree"]]
        trees[r["tree"]][r["id"]] = r
    for nodes in trees:
        assert len(nodes) > 50
        for r in nodes.values():
            if r["feature"] >= 0:
                a, b = nodes[r["left"]], nodes[r["right"]]
                assert a["weight"] + b["weight"] == pytest.approx(r["weight"])
                assert a["weight"] * a["p"] + b["weight"] * b["p"] == pytest.approx(r["weight"] * r["p"])
                gini = [2 * z["weight"] * z["p"] * (1 - z["p"]) for z in (r, a, b)]
                assert r["gain"] == pytest.approx(gini[0] - gini[1] - gini[2]) and r["gain"] > 0
    got = {r["doc_id"]: r for r in model.transform(data).collect()}
    right = 0
    for r in got.values():
        x = r["features"].toArray()
        want = np.mean([nodes[walk(nodes, x)]["p"] for nodes in trees])
        assert r["probability"][1] == pytest.approx(want)
        right += (want >= 0.5) == (r["y"] == 1)
    assert right > (420 if sparse else 540)  # most sparse rows have nothing that tells their label
    importance = model.featureImportances.toArray()
    assert importance.sum() == pytest.approx(1) and importance.argmax() == 0


def test_parts_do_not_change_a_tree_that_sees_all_features(spark, monkeypatch):
    """One tree takes every row and feature, so that nothing is drawn: its nodes are the same whoever splits them."""
    data, preset = table(spark), PRESET | {"trees": 1}
    found = []
    for rows_in_group in (1 << 17, 40):
        monkeypatch.setattr(forest, "ROWS_IN_GROUP", rows_in_group)
        nodes = forest.fit_forest(data, preset, 30, 42).nodes.drop("gain")
        found.append({r["id"]: tuple(round(x, 9) for x in r) for r in nodes.collect()})
    assert found[0] == found[1] and len(found[0]) > 50


def test_depth_leaf_and_large_leaves(spark, monkeypatch):
    monkeypatch.setattr(forest, "ROWS_IN_GROUP", 20)
    data = table(spark)
    nodes = forest.fit_forest(data, PRESET | {"depth": 2}, 30, 42).nodes
    assert nodes.agg(F.max("id")).first()[0] <= 7
    same = data.withColumn("features", F.lit(None).cast("double")).drop("features")
    same = same.join(data.where("doc_id = 3").select("features"))
    alike = forest.fit_forest(same, PRESET, 30, 42)
    assert [(r["id"], r["feature"]) for r in alike.nodes.collect()] == [(1, -1)] * 6
    assert not alike.featureImportances.toArray().any()


def test_fits_agree_and_survive_storage(spark, tmp_path):
    data = table(spark)
    model = forest.fit_forest(data, PRESET, 30, 42)
    again = forest.fit_forest(data, PRESET, 30, 42)
    assert model.nodes.exceptAll(again.nodes).count() == 0
    model.save(str(tmp_path / "forest"))
    read = forest.load_forest(spark, str(tmp_path / "forest"))
    same = model.transform(data).select("doc_id", "probability").exceptAll(read.transform(data).select("doc_id", "probability"))
    assert same.count() == 0


def test_labels_have_to_be_there(spark):
    with pytest.raises(Exception, match="labels have to be 0 or 1"):
        forest.fit_forest(table(spark, 20).withColumn("y", F.lit(None).cast("int")), PRESET, 30, 42)


def test_what_passes_the_driver_is_eight_bytes_a_node(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(forest, "NODES_PER_PIECE", 400)
    data = table(spark)
    model = forest.fit_forest(data, PRESET, 30, 42)
    n = model.nodes.count()
    model.save(str(tmp_path / "forest"))
    read = forest.load_forest(spark, str(tmp_path / "forest"))  # has thresholds only
    for m in (model, read):
        cuts, *pieces = m.pieces()
        assert len(pieces) > 1 and sum(len(p.value.words) for p in pieces) == n
        leaves = sum(len(p.value.leaves) for p in pieces)
        assert sum(len(pickle.dumps(p.value)) for p in pieces) < 8 * (n + leaves) + 1000 * len(pieces) < 16 * n
        assert all(len(c) <= forest.BINS for c in cuts.value)


def test_missing_values_are_over_no_threshold(spark):
    model = forest.fit_forest(table(spark), PRESET, 30, 42)
    rows = spark.createDataFrame([(k, Vectors.dense([x, 0.1, x, -0.2, 0.3])) for k, x in enumerate((float("nan"), -1e300))], ["k", "features"])
    nan, low = (r["probability"][1] for r in model.transform(rows).orderBy("k").collect())
    assert nan == low
