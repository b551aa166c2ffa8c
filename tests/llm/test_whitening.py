"""Whitening: rank-one updates against a full decomposition, and the result against exact integer arithmetic."""

import numpy as np
import pytest
from pyspark.errors import PythonException

from stylotrace.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>"


def matrices():
    rng = np.random.default_rng(0)
    yield np.floor(256 * rng.normal(size=(150, 24)) * np.linspace(0.1, 3, 24))
    yield np.floor(256 * np.hstack([rng.normal(size=(80, 5)), np.zeros((80, 7))]))  # no variance in most dimensions
    yield np.floor(rng.normal(size=(200, 6)))  # many equal rows and eigenvalues
    yield np.repeat(np.floor(256 * rng.normal(size=(3, 16))), 20, axis=0)  # rank 2
    yield np.floor(256 * rng.normal(size=(40, 1)))
    yield np.full((9, 4), 7.0)
    yield np.floor(1e6 * rng.normal(size=(60, 8)) * [1e-6, 1e-3, 1, 1, 1, 1, 1, 1])


@pytest.mark.parametrize("rows", list(matrices()))
def test_rank_one_updates_and_combination(rows):
    away = rows - rows.mean(axis=0)
    scatter, d = away.T @ away, rows.shape[1]
    size = max(np.abs(scatter).max(), 1.0)
    whole, first, second = (wh.Spectrum.empty(d) for _ in range(3))
    for k, row in enumerate(rows):
        whole.add(row)
        (first if k < len(rows) // 3 else second).add(row)
    first.combine(second)
    for s in (whole, first):
        assert s.n == len(rows)
        assert np.abs(s.vectors.T @ s.vectors - np.eye(d)).max() < 1e-12
        assert np.abs(s.vectors @ np.diag(s.values) @ s.vectors.T - scatter).max() / size < 1e-12
        assert (np.diff(s.values) >= 0).all()


def test_secular_roots_interlace():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 30):
        for spread in (1e-10, 1.0, 1e8):
            d, z = np.sort(rng.normal(size=k)) * spread, rng.normal(size=k) * rng.choice([1e-6, 1, 1e3], k)
            origin, x = wh.secular_roots(d, z)
            roots = d[origin] + x
            want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
            assert np.abs(roots - want).max() <= 1e-13 * max(np.abs(want).max(), 1e-300) * k
            assert (roots >= d).all() and (roots[:-1] <= d[1:]).all()


def brute(vectors, k=4):
    """{(id, component): (n, deviation, whitened, explained)} with integers of any size for the exact parts."""
    usable = [(i, v) for i, v in vectors if v and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    x = [(i, tuple(int(np.floor(256 * float(np.float32(c)))) for c in v)) for i, v in usable]
    fit = sorted({p for _, p in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    away = np.array([[n * a - s for a, s in zip(p, sums)] for p in fit], np.float64) / n
    covariance = away.T @ away / n
    values, columns = np.linalg.eigh(covariance)
    values, columns = values[::-1], columns[:, ::-1]
    out = []
    for i, p in x:
        deviation = sum((n * a - s) ** 2 for a, s in zip(p, sums))
        row = np.array([n * a - s for a, s in zip(p, sums)], np.float64) / n
        for c in range(min(k, len(sums))):
            out.append((i, c + 1, n, deviation, float(row @ columns[:, c] / np.sqrt(values[c])), values[c] / values.sum()))
    return out


def vectors(seed=2, n=400, d=12):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d))
    rows = [(i, (rng.normal(size=d) @ mix * 0.3).tolist()) for i in range(n)]
    rows += [(1000 + k, rows[5][1]) for k in range(200)]  # copies are fitted once
    rows += [(5, rows[5][1]), (None, rows[6][1]), (2000, None), (2001, [None, *rows[1][1][1:]]), (2002, [float("nan")] * d)]
    return rows + [(2003, [float("inf"), *rows[1][1][1:]]), (2004, []), (2005, [-0.0] * d)]


@pytest.mark.parametrize("per_spectrum", [8, 4096])
def test_against_brute_force(spark, monkeypatch, per_spectrum):
    monkeypatch.setattr(wh, "ROWS_PER_SPECTRUM", per_spectrum)
    rows = vectors()
    got = wh.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = brute(rows)
    assert len(got) == len(want)
    order = lambda r: (r[1], r[0] is None, r[0] or 0)
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    for c in range(1, 5):
        mine, theirs = ([r for r in x if r[1] == c] for x in (got, want))
        assert [r[:4] for r in mine] == [r[:4] for r in theirs]
        a, b = np.array([r[4] for r in mine]), np.array([r[4] for r in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        assert mine[0][5] == pytest.approx(theirs[0][5], rel=1e-10)
    assert 0 <= got[0][6] < 1e-9 and len({r[6] for r in got}) == 1


def test_combination_in_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(wh, "FAN", 2)
    monkeypatch.setattr(wh, "ROWS_PER_SPECTRUM", 40)
    rows = vectors(3)
    got = {(r.vec_id, r.component): r for r in wh.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, c, n, deviation, white, share in brute(rows):
        r = got[i, c]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(abs(white), abs=1e-9) and r.explained == pytest.approx(share)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert wh.whiten(empty).count() == 0
    unusable = spark.createDataFrame([(1, None), (2, [None]), (3, [])], SCHEMA)
    assert wh.whiten(unusable).count() == 0
    equal = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)
    assert wh.whiten(equal).count() == 0  # no component has variance
    line = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(5)], SCHEMA)
    assert {r.component for r in wh.whiten(line).collect()} == {1}
    with pytest.raises(ValueError, match="entries"):
        wh.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], SCHEMA))
    with pytest.raises(PythonException, match="64 bits"):
        wh.whiten(spark.createDataFrame([(1, [3e15, 1.0]), (2, [-3e15, 2.0]), (3, [1e15, 0.0])], SCHEMA)).collect()


def test_clashing_names(spark):
    names = ["id", "x", "n", "part", "component", "deviation", "whitened", "deal"]
    wide = spark.createDataFrame([(*r, *names) for r in vectors()], SCHEMA + "".join(f", {c} string" for c in names))
    assert wh.whiten(wide).count() == len(brute(vectors()))
