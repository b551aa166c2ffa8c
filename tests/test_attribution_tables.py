"""Attributions from tables: equal to those of every row at every leaf, without rows meeting leaves."""

import numpy as np
import pytest

from stylotrace.operators import attribution


def grown(rng, d, depth):
    """The nodes of a tree with random cuts, some of them repeated."""
    rows = []

    def add(i, left, weight):
        if left == 0 or (left < depth and rng.random() < 0.15):
            rows.append((i, -1, -1, -1, 0.0, weight, rng.random()))
            return
        f, cut, share = int(rng.integers(d)), float(rng.integers(-3, 4)), rng.uniform(0.1, 0.9)
        rows.append((i, 2 * i, 2 * i + 1, f, cut, weight, 0.5))
        add(2 * i, left - 1, weight * share)
        add(2 * i + 1, left - 1, weight * (1 - share))

    add(1, depth, 100.0)
    rows.sort()
    return {c: np.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(attribution.NODE_KINDS.items())}


def by_leaf(x, trees):
    out = np.zeros((x.shape[1] + 1, len(x)))
    for t in trees:
        at = {i: k for k, i in enumerate(t["id"].tolist())}
        stack = [(1, {})]
        while stack:
            i, path = stack.pop()
            k = at[i]
            if t["left"][k] < 0:
                items = sorted(path.items())
                low, high, share = ([v[j] for _, v in items] for j in range(3))
                leaf = {"value": t["p"][k], "feature": [f for f, _ in items], "low": low, "high": high, "share": share}
                found, value = attribution.leaf_attribution(x, attribution.Leaves([leaf]))
                out[:-1] += found.T
                out[-1] += value
                continue
            f, cut = int(t["feature"][k]), t["threshold"][k]
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for side, interval in (("left", (low, min(high, cut))), ("right", (max(low, cut), high))):
                part = share * t["weight"][at[t[side][k]]] / t["weight"][k]
                stack.append((int(t[side][k]), path | {f: (*interval, part)}))
    return out


@pytest.mark.parametrize("bound", [1, 40, 1 << 14])
@pytest.mark.parametrize("missing", [False, True])
def test_tables_equal_leaves(monkeypatch, bound, missing):
    monkeypatch.setattr(attribution, "CELLS_IN_TABLE", bound)
    monkeypatch.setattr(attribution, "ROWS_AT_ONCE", 100)
    rng = np.random.default_rng(8)
    trees = [grown(rng, 5, depth) for depth in (6, 5, 1, 0)]
    x = rng.integers(-4, 5, (700, 5)) + rng.choice([0.0, 0.5], (700, 5))
    if missing:
        x[rng.random(x.shape) < 0.05] = np.nan
    assert attribution._attribution(x, trees) == pytest.approx(by_leaf(x, trees), abs=1e-12)


def test_rows_do_not_meet_leaves(monkeypatch):
    rng = np.random.default_rng(9)
    trees, x = [grown(rng, 5, 6)], rng.normal(size=(3000, 5))
    want = by_leaf(x, trees)
    monkeypatch.setattr(attribution, "leaf_attribution", None)  # rows times leaves
    assert attribution._attribution(x, trees) == pytest.approx(want, abs=1e-12)
    assert attribution._attribution(x[:0], trees).shape == (6, 0)


def test_blocks_and_parts_do_not_change_attributions(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler

    from stylotrace.operators import models

    rng, names = np.random.default_rng(3), ["a", "b", "c", "d"]
    data = [(i % 290, int(x[0] + x[1] * x[2] > 0), *map(float, x)) for i, x in enumerate(rng.normal(size=(300, 4)).round(1))]
    rows = spark.createDataFrame(data, "doc_id long, y int, a double, b double, c double, d double")
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = models.grown_forest(ready, {"trees": 7, "depth": 6, "leaf": 1, "balanced": False})
    found = []
    for cells, parts, piece in ((1 << 20, 32, 4 << 20), (1100, 2, 100), (1100, 1, 1 << 20)):
        monkeypatch.setattr(attribution, "CELLS_IN_BLOCK", cells)
        monkeypatch.setattr(attribution, "PARTS", parts)
        monkeypatch.setattr(attribution, "CELLS_PER_PIECE", piece)
        got = attribution.tree_attribution(rows, forest, names).collect()
        found.append(sorted((r.doc_id, r.feature, round(r.contribution, 9) + 0.0, round(r.p, 9), round(r.base, 9)) for r in got))
    assert len(found[0]) == 1200 and found[0] == found[1] == found[2]
