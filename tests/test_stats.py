import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stylotrace.functions.numbers import entropy_bits, erfc, sanitise
from stylotrace.operators import stats


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"doc_id": np.arange(n), "y": rng.integers(0, 2, n)})
    pdf["a"] = rng.normal(size=n) + pdf.y
    pdf["b"] = np.round(pdf.a + rng.normal(size=n), 1)
    pdf["c"] = np.where(rng.random(n) < 0.4, 0.0, rng.random(n))
    return pdf


@pytest.fixture(scope="module")
def frame(spark, sample):
    return spark.createDataFrame(sample)


def test_numbers(spark):
    zs = [-3.0, -0.5, 0.0, 0.3, 1.0, 2.5, 6.0, 20.0]
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", erfc(F.col("z")).alias("e")).collect():
        assert r["e"] == pytest.approx(math.erfc(r["z"]), rel=1e-12)
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.5,)], "x double")
    assert [r["x"] for r in odd.select(sanitise(F.col("x")).alias("x")).collect()] == [0, 0, 0, 0, 2.5]
    assert spark.range(1).select(entropy_bits(F.lit(0), F.lit(0.0)).alias("e")).first()["e"] == 0


def test_mann_whitney_golden(spark):
    rows = [(0, float(v)) for v in (1, 2, 2, 5)] + [(1, float(v)) for v in (2, 3, 4, 4, 6)]
    got = stats.mann_whitney(spark.createDataFrame(rows, "y int, x double"), "y", ["x"]).first()
    assert got["u"] == 5 and got["effect"] == 0.5
    assert got["p_value"] == pytest.approx(0.260175, abs=1e-6)


def test_mann_whitney_exact(spark):
    human, ai = [1.0, 2.5, 3.5, 9.0], [0.5, 4.0, 5.0, 6.0, 7.0, 8.0]
    rows = [(0, v) for v in human] + [(1, v) for v in ai]
    got = stats.mann_whitney(spark.createDataFrame(rows, "y int, x double"), "y", ["x"]).first()
    everything = sorted(human + ai)
    us = [sum(everything.index(v) for v in c) - 6 for c in itertools.combinations(everything, 4)]
    u = sum(everything.index(v) for v in human) - 6
    larger = max(u, 24 - u)
    assert got["u"] == u
    assert got["p_value"] == pytest.approx(min(1, 2 * sum(x >= larger for x in us) / len(us)))


def test_mann_whitney_sides_add_up(frame, sample):
    got = {r["feature"]: r for r in stats.mann_whitney(frame, "y", ["a", "b", "c"]).collect()}
    flipped = frame.withColumn("y", 1 - F.col("y"))
    other = {r["feature"]: r for r in stats.mann_whitney(flipped, "y", ["a", "b", "c"]).collect()}
    n1 = int((sample.y == 0).sum())
    for f in "abc":
        assert got[f]["u"] + other[f]["u"] == n1 * (len(sample) - n1)
        assert got[f]["p_value"] == pytest.approx(other[f]["p_value"])
        ranks = sample[f].rank()
        assert got[f]["u"] == ranks[sample.y == 0].sum() - n1 * (n1 + 1) / 2


def test_describe_and_boxes(frame, sample):
    names = {"q25": "25%", "q50": "50%", "q75": "75%"}
    expected = sample[["a", "b", "c"]].describe()
    for r in stats.describe(frame, ["a", "b", "c"]).collect():
        for k in ("mean", "std", "min", "q25", "q50", "q75", "max"):
            assert r[k] == pytest.approx(expected[r["feature"]][names.get(k, k)], abs=6e-4)
    for r in stats.box_summary(frame, ["y"], ["a", "c"]).collect():
        side = sample[sample.y == r["y"]][r["feature"]]
        assert (r["n_rows"], r["min"], r["max"]) == (len(side), side.min(), side.max())
        assert [r[q] for q in names] == pytest.approx(list(side.quantile([0.25, 0.5, 0.75])))


@pytest.mark.parametrize("hot_floor", [1000, 5])
def test_spearman(frame, sample, hot_floor):
    expected = sample[["a", "b", "c"]].rank().corr()
    got = {(r["feature_a"], r["feature_b"]): r["rho"] for r in stats.spearman_matrix(frame, "doc_id", ["a", "b", "c"], hot_floor).collect()}
    assert set(got) == {("b", "a"), ("c", "a"), ("c", "b")}
    for (x, y), rho in got.items():
        assert rho == pytest.approx(expected.loc[x, y])


def test_histogram_and_density(frame, sample):
    got = stats.probability_histogram(frame, "y", "a").toPandas()
    curve = stats.kde_curve(frame, "y", "a").toPandas()
    for y in (0, 1):
        side = sample[sample.y == y].a.to_numpy()
        density, edges = np.histogram(side, bins=40, density=True)
        mine = got[got.y == y].sort_values("bin")
        assert mine.density.to_numpy() == pytest.approx(density) and mine.lower.to_numpy() == pytest.approx(edges[:-1])
        h = side.std(ddof=1) * len(side) ** -0.2
        xs = np.linspace(0, 1, 300)
        by_hand = np.exp(-0.5 * ((xs[:, None] - side) / h) ** 2).sum(1) / (len(side) * h * math.sqrt(2 * math.pi))
        assert curve[curve.y == y].sort_values("point").density.to_numpy() == pytest.approx(by_hand)


def test_ranking(spark):
    rows = [("a", 0.05), ("b", 0.5), ("c", 0.3), ("d", 0.3)]
    got = stats.feature_ranking(spark.createDataFrame(rows, "feature string, effect double"), 3).collect()
    assert [(r["feature"], r["band"]) for r in got] == [("b", "large"), ("c", "medium"), ("d", "medium")]


def test_exact_p_counts_equal_enumeration_and_do_not_grow_with_the_larger_sample():
    import itertools
    import math
    import tracemalloc

    from stylotrace.operators.stats import count_up_to

    for small, big in [(1, 1), (1, 6), (2, 5), (3, 3), (4, 7), (5, 5)]:
        us = [sum(x - i for i, x in enumerate(c)) for c in itertools.combinations(range(small + big), small)]
        for most in range(-1, small * big + 2):
            assert count_up_to(most, small, big) == sum(u <= most for u in us)
    assert count_up_to(8 * 40, 8, 40) == math.comb(48, 8)
    tracemalloc.start()
    half = count_up_to(8 * 10**8 // 2, 8, 10**8) / math.comb(10**8 + 8, 8)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert 0.5 < half < 0.500001
