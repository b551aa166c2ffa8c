"""Splits of sparse rows from their stored cells alone are those of the whole table of counts."""

import numpy as np
import pytest

from stylotrace.operators import forest


def found(rng, d, sparse_mode, monkeypatch, seen):
    n = 900
    x = rng.integers(1, 6, (n, d)) * (rng.random((n, d)) < 0.05)
    y = ((x[:, 0] + x[:, 1] > 2) ^ (rng.random(n) < 0.1)).astype(np.uint8)
    edges = [np.array([0.0, 1.0, 2.0, 3.0, 4.0]) - (f % 3) for f in range(d)]  # the bin of 0 is not always the first
    empty = np.array([np.searchsorted(e, 0.0) for e in edges], np.uint8)
    at, feature = np.nonzero(x)
    bins = np.array([np.searchsorted(edges[f], v) for f, v in zip(feature, x[at, feature], strict=True)], np.uint8)
    columns = {
        "row": np.zeros(0, np.int64), "draws": rng.integers(1, 4, n).astype(np.uint8), "y": y,
        "w": rng.integers(1, 1 << 20, n).astype(float), "n": np.bincount(at, minlength=n).astype(np.int32),
        "feature": feature.astype(np.int32), "bin": bins,
    }
    rows = forest.Rows(columns)
    if not sparse_mode:
        whole = rows.matrix(d, empty)
        rows = forest.Rows(columns | {"n": columns["n"][:0], "feature": columns["feature"][:0], "bin": whole.ravel()})
    counts = forest._counts
    monkeypatch.setattr(forest, "_counts", lambda *a: seen.append(1) or counts(*a))
    return forest._grow(rows, 3, 1, d, forest.Plan(9, 30, 1, 7, 42, edges, empty))


@pytest.mark.parametrize("cells", [1 << 20, 700])
def test_same_trees_without_counting_empty_cells(monkeypatch, cells):
    monkeypatch.setattr(forest, "CELLS_AT_ONCE", cells)
    seen = []
    got = found(np.random.default_rng(4), 40, True, monkeypatch, seen)
    assert not seen
    want = found(np.random.default_rng(4), 40, False, monkeypatch, seen)
    assert seen and sum(map(len, want["id"])) > 100
    for c in want:
        assert np.array_equal(np.concatenate(got[c]), np.concatenate(want[c])), c
