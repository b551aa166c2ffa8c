"""A forest that is too large for every worker is scored piece by piece, with the same probabilities."""

import pytest
from pyspark.ml.linalg import Vectors

from stylotrace.operators import forest
from tests.test_forest import PRESET, table


@pytest.mark.parametrize("sparse", [False, True])
def test_pieces_that_stay_apart_give_the_same_probabilities(spark, monkeypatch, sparse):
    monkeypatch.setattr(forest, "NODES_PER_PIECE", 300)
    monkeypatch.setattr(forest, "DENSE", 4 if sparse else 256)
    data = table(spark, sparse=sparse)
    data = data.unionByName(data.where("doc_id < 40"))  # an id twice is a row twice
    model = forest.fit_forest(data, PRESET, 30, 42)
    nan = spark.createDataFrame([(-1, Vectors.dense([float("nan"), 0.1, 0.0, -0.2, 0.3]))], ["doc_id", "features"])
    rows = data.select("doc_id", "features").unionByName(nan)
    want = model.transform(rows).select("doc_id", "probability")
    monkeypatch.setattr(forest, "NODES_TOGETHER", 100)
    monkeypatch.setattr(forest, "BYTES_OF_ROWS", 1000)
    read = forest.ForestModel(model.nodes, model.n_features, model.trees)
    monkeypatch.setattr(forest.ForestModel, "pieces", None)  # nothing is broadcast to every worker
    for m in (model, read):
        got = m.transform(rows)
        assert got.columns == ["doc_id", "features", "probability"]
        got = got.select("doc_id", "probability")
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == 641
    assert model.transform(rows.limit(0)).count() == 0
