"""Vantage-point trees against brute force."""

import numpy as np
import pytest

from stylotrace.llm import vptree

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, k):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = min(ok.get(i, v), v)
    ids = sorted(ok)
    points = np.array([ok[i] for i in ids], np.float32).astype(float)
    out = {}
    for q, i in enumerate(ids):
        if i % 20 == 0:
            scores = (points * points[q]).sum(axis=1)
            order = sorted((-s, j) for s, j in zip(scores, ids) if j != i)[:k]
            out[i] = [(j, -s) for s, j in order]
    return out


def clusters(n, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, 16))
    points = (centers[rng.integers(12, size=n)] + 0.4 * rng.normal(size=(n, 16))).astype(np.float32)
    points[: n // 3] = points[0]  # a third of all vectors are equal
    return [(i, p.tolist(), None) for i, p in enumerate(points)]


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = {}
    for r in vptree.nearest(df, df.where("vec_id % 20 = 0"), **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_factor_one_is_exact(spark):
    rows = [*clusters(900, 1), (2000, None, None), (2020, [0.0] * 16, None), (2040, [float("nan")] + [1.0] * 15, None)]
    rows += [(None, [1.0] * 16, None), (2060, [None] + [1.0] * 15, None), (20, rows[20][1], None)]
    got, want = found(spark, rows, k=7, factor=1.0, shard_rows=200, block_rows=16), brute(rows, 7)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_recall_with_the_production_factor(spark):
    rows = clusters(1500, 2)
    got, want = found(spark, rows, shard_rows=500), brute(rows, 20)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9


def test_fewer_candidates_than_asked_and_empty_table(spark):
    rows = clusters(5, 3)
    assert {q: len(v) for q, v in found(spark, rows).items()} == {0: 4}
    assert found(spark, rows[:1]) == {}
    assert vptree.nearest(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 65, 300])
def test_a_tree_holds_every_point_once(n):
    rng = np.random.default_rng(n)
    tree = vptree.build(np.arange(n), rng.normal(size=(n, 4)))
    leaves = tree.inner < 0
    inner = int((tree.stop - tree.start)[leaves].sum() + (~leaves).sum())
    assert inner == n and sorted(tree.ids.tolist()) == list(range(n))


def test_vectors_of_several_lengths_are_refused(spark):
    rows = [(0, [1.0, 2.0], None), (20, [1.0, 2.0, 3.0], None), (3, [1.0], None)]
    with pytest.raises(ValueError, match="entries"):
        found(spark, rows)


@pytest.mark.parametrize("shard_rows", [64, 100_000])
def test_shards_and_blocks_do_not_change_exact_results(spark, shard_rows):
    rows = clusters(400, 4)
    got, want = found(spark, rows, k=5, factor=1.0, shard_rows=shard_rows, block_rows=3), brute(rows, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
