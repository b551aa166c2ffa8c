"""The mix against a plain reckoning of targets, order and moments."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylotrace.llm import curriculum

SCHEMA = "doc_id long, source string, text string, size string"


def reckon_targets(sizes, weights, share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), share * sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def reckon(rows):
    size = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in rows]
    totals = {}
    for _, s, n in size:
        totals[s] = totals.get(s, 0) + n
    target, out = reckon_targets(totals, curriculum.WEIGHTS), []
    for s in totals:
        at = 0
        mine = [(hashlib.md5(f"7:{i}".encode() if i is not None else b"7").hexdigest(), i, n) for i, x, n in size if x == s]
        for _, i, n in sorted(mine, key=lambda x: (x[0], x[1] or 0, x[2])):
            passes = sum(at + n / 2 + e * totals[s] <= target[s] for e in range(2))
            out.append((i, n, totals[s], round(target[s], 6), n * passes))
            at += n
    return sorted(out, key=repr)


def corpus():
    rng = np.random.default_rng(2)
    names = ["a", "B", "é", "zz", "m", None, "\U0001f600", "empty", "b"]
    rows = []
    for i in range(600):
        s = "a" if i % 3 == 0 else names[int(rng.integers(len(names)))]
        text = None if i % 50 == 7 else "" if s == "empty" else "w \x0b" * int(rng.integers(0, 60))
        rows.append((i, s, text))
    return [*rows, (None, "a", " lead word"), (3, "a", "again"), (3, "a", "again")]


def test_plan_equals_reckoning(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(7)
    got = curriculum.plan(df, rows_per_bucket=40).collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=repr) == reckon(rows)
    again = curriculum.plan(df.repartition(2), rows_per_bucket=1000).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_taken_words_come_near_targets(spark):
    df = spark.createDataFrame([(*r, "clash") for r in corpus()], SCHEMA)
    by = {}
    for r in curriculum.plan(df).select("source_size", "target", "taken").collect():
        entry = by.setdefault((r.source_size, r.target), [0])
        entry[0] += r.taken
    assert all(abs(taken - target) <= 30 for (_, target), (taken,) in by.items())


@pytest.mark.parametrize("schedule", curriculum.SCHEDULES)
def test_moments_invert_the_integral(spark, schedule):
    moments = spark.range(101).select(curriculum._reached(F.col("id") / 100, schedule).alias("t")).toPandas().t.to_numpy()
    assert (np.diff(moments) > 0).all() and moments[0] == 0 and abs(moments[-1] - 1) < 1e-9
    fine = np.linspace(0, 1, 200_001)
    strength = np.interp(fine, *zip(*schedule))
    area = np.concatenate([[0], np.cumsum((strength[1:] + strength[:-1]) / 2)])
    assert np.allclose(np.interp(moments, fine, area / area[-1]), np.arange(101) / 100, atol=1e-5)


def test_many_sources_are_numbered_in_order(spark, monkeypatch):
    monkeypatch.setattr(curriculum, "SOURCES_PER_TASK", 50)
    names = [f"s{i}é" if i % 2 else f"S{i}" for i in range(400)] + [None]
    sizes = spark.createDataFrame([(n, 1) for n in names], "source string, source_size long").repartition(6)
    got = {r.source: r.nth for r in curriculum.numbered_sources(sizes).collect()}
    want = sorted(names, key=lambda s: (s is None, (s or "").encode()))
    assert got == {s: k for k, s in enumerate(want)}


def test_mixed_rows_follow_the_plan(spark):
    df = spark.createDataFrame([(*r, "clash") for r in corpus() if r[0] is not None and r[2] != "again"], SCHEMA)
    want = {r.doc_id: len(r.positions) for r in curriculum.plan(df).collect()}
    rows = curriculum.mixed(df)
    assert rows.columns == df.columns
    got = [r.doc_id for r in rows.collect()]
    assert {i: got.count(i) for i in want} == want
    order = [r.doc_id for r in curriculum.training_order(curriculum.plan(df)).collect()]
    assert got == order


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert curriculum.plan(df).count() == 0 and curriculum.mixed(df).count() == 0
    blank = spark.createDataFrame([(1, "a", " ", None), (2, None, None, None)], SCHEMA)
    assert [r.taken for r in curriculum.plan(blank).collect()] == [0, 0]
