import random

import pytest
from pyspark.sql import functions as F

from stylotrace.operators import evaluate


def by_hand(rows):
    """Curves by trying every threshold."""
    p = sum(y for y, _ in rows)
    n = len(rows) - p
    points = [(t, sum(y for y, s in rows if s >= t), sum(1 - y for y, s in rows if s >= t)) for t in sorted({s for _, s in rows}, reverse=True)]
    pairs = sum((a > b) + (a == b) / 2 for ya, a in rows if ya for yb, b in rows if not yb)
    ap, before = 0.0, 0
    for _, tp, fp in points:
        ap += (tp - before) / p * tp / (tp + fp)
        before = tp
    return p, n, points, pairs / (p * n), ap


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(y, round(min(max(rng.gauss(0.4 + 0.2 * y, 0.2), 0.0), 1.0), 2)) for y in [0, 1] * 150 + [0] * 60]


@pytest.fixture(scope="module")
def pred(spark, rows):
    return spark.createDataFrame(rows, "y int, p double")


def test_golden(spark):
    got = evaluate.metric_rows(spark.createDataFrame(list(zip([1, 0, 1, 1, 0, 0], [0.9, 0.8, 0.8, 0.6, 0.4, 0.1])), "y int, p double"), digits=None).first()
    assert got["auc_roc"] == pytest.approx(0.833333, abs=1e-6) and got["ap"] == pytest.approx(0.805556, abs=1e-6)


def test_metrics(pred, rows):
    p, n, _, auc, ap = by_hand(rows)
    got = evaluate.metric_rows(pred, digits=None).first()
    tp = sum(y for y, s in rows if s >= 0.5)
    fp = sum(1 - y for y, s in rows if s >= 0.5)
    assert got["auc_roc"] == pytest.approx(auc) and got["ap"] == pytest.approx(ap)
    assert got["precision"] == pytest.approx(tp / (tp + fp)) and got["recall"] == pytest.approx(tp / p)
    assert got["accuracy"] == pytest.approx((tp + n - fp) / (p + n))
    same = evaluate.threshold_metrics(pred).first()
    assert all(same[m] == pytest.approx(got[m]) for m in ("accuracy", "precision", "recall", "f1"))
    mirrored = evaluate.metric_rows(pred.withColumn("p", -F.col("p")), digits=None).first()
    assert mirrored["auc_roc"] == pytest.approx(1 - auc)


def test_many_experiments_at_once(pred):
    both = pred.withColumn("m", F.lit("a")).unionByName(pred.withColumn("p", F.lit(0.5)).withColumn("m", F.lit("b")))
    got = {r["m"]: r for r in evaluate.metric_rows(both, ["m"]).collect()}
    assert got["b"]["auc_roc"] == 0.5 and got["b"]["recall"] == 1.0
    assert got["a"]["auc_roc"] == evaluate.metric_rows(pred).first()["auc_roc"]


def test_curves(pred, rows):
    p, n, points, _, _ = by_hand(rows)
    roc = evaluate.roc_curve(pred).collect()
    exact = {t: (fp / n, tp / p) for t, tp, fp in points}
    kept = [r for r in roc if r["threshold"] is not None]
    assert len(roc) == len(kept) + 1 and all(exact[r["threshold"]] == (r["fpr"], r["tpr"]) for r in kept)
    assert {points[0][0], points[-1][0]} <= {r["threshold"] for r in kept}
    # Dropped points lie on the line between their kept neighbours.
    line = sorted((r["fpr"], r["tpr"]) for r in roc)
    for t, (x, y) in exact.items():
        left = max(q for q in line if q[0] <= x and q[1] <= y)
        right = min(q for q in line if q[0] >= x and q[1] >= y)
        assert (right[0] - left[0]) * (y - left[1]) == pytest.approx((x - left[0]) * (right[1] - left[1]))
    pr = {r["threshold"]: (r["precision"], r["recall"]) for r in evaluate.pr_curve(pred).collect()}
    assert pr.pop(None) == (1.0, 0.0)
    assert pr == {t: (tp / (tp + fp), tp / p) for t, tp, fp in points}


def test_confusion_and_report(pred, rows):
    cells = {(r["y"], r["y_pred"]): r for r in evaluate.confusion_matrix(pred).collect()}
    assert sum(r["n"] for r in cells.values()) == len(rows)
    assert cells[0, 0]["share"] + cells[0, 1]["share"] == pytest.approx(1)
    report = {r["label"]: r for r in evaluate.classification_report(pred).collect()}
    ai = evaluate.metric_rows(pred, digits=None).first()
    assert report["ai"]["f1"] == pytest.approx(ai["f1"]) and report["accuracy"]["f1"] == pytest.approx(ai["accuracy"])
    assert report["macro avg"]["recall"] == pytest.approx((report["ai"]["recall"] + report["human"]["recall"]) / 2)


def test_one_class_and_no_hits(spark):
    got = evaluate.metric_rows(spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double")).first()
    assert (got["precision"], got["recall"], got["f1"], got["auc_roc"], got["accuracy"]) == (0, 0, 0, 0, 1)
