"""Quality of scored rows, for many experiments at once.

Input is a table of predictions with a label ``y`` (0/1), a score ``p`` and any key columns that name
the experiment (method, scenario, fold, feature subset). Every metric comes from one table of counts
per distinct score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stylotrace.functions.numbers import ratio
from stylotrace.operators.ordering import join_keys, prefix_sum

METRICS = ["accuracy", "precision", "recall", "f1", "auc_roc", "ap"]


def score_counts(pred: DataFrame, keys: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    return pred.groupBy(*keys, F.col(p).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )


def _running(pred: DataFrame, keys: Sequence[str], y: str, p: str, following: Sequence[str] = ()) -> DataFrame:
    """Counts per score, best first, with true and false positives at that threshold."""
    out = prefix_sum(score_counts(pred, keys, y, p), keys, "score", ["pos", "neg"], descending=True, following=following)
    return out.withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})


def confusion_matrix(pred: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """All four cells with counts and shares of the true class."""
    hit = (F.col(p) >= threshold).cast("int")
    cells = [
        F.struct(F.lit(t).alias("y"), F.lit(q).alias("y_pred"), F.col(f"_{t}{q}").alias("n"))
        for t in (0, 1)
        for q in (0, 1)
    ]
    counts = pred.groupBy(*keys).agg(
        *[F.count_if((F.col(y) == t) & (hit == q)).alias(f"_{t}{q}") for t in (0, 1) for q in (0, 1)]
    )
    rows = counts.select(*keys, F.inline(F.array(*cells)))
    per_class = F.sum("n").over(Window.partitionBy(*keys, "y"))  # two rows each
    return rows.withColumn("share", ratio(F.col("n"), per_class))


def classification_metrics(tp, fp, fn, tn) -> dict:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": precision,
        "recall": recall,
        "f1": ratio(2.0 * tp, 2.0 * tp + fp + fn),
    }


def threshold_metrics(pred: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1; 0 where a denominator is empty."""
    hit, positive = F.col(p) >= threshold, F.col(y) == 1
    counts = pred.groupBy(*keys).agg(
        F.count_if(positive & hit).alias("tp"),
        F.count_if(~positive & hit).alias("fp"),
        F.count_if(positive & ~hit).alias("fn"),
        F.count_if(~positive & ~hit).alias("tn"),
    )
    m = classification_metrics(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return counts.select(*keys, *[v.alias(k) for k, v in m.items()])


def classification_report(pred: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted averages."""
    hit, positive = F.col(p) >= threshold, F.col(y) == 1
    counts = pred.groupBy(*keys).agg(
        F.count_if(positive & hit).cast("double").alias("tp"),
        F.count_if(~positive & hit).cast("double").alias("fp"),
        F.count_if(positive & ~hit).cast("double").alias("fn"),
        F.count_if(~positive & ~hit).cast("double").alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ai = classification_metrics(tp, fp, fn, tn)
    human = classification_metrics(tn, fn, fp, tp)
    n_ai, n_human = tp + fn, tn + fp
    names = ("precision", "recall", "f1")

    def entry(name, values, support):
        return F.struct(
            F.lit(name).alias("label"), *[values[m].alias(m) for m in names], support.cast("bigint").alias("support")
        )

    accuracy = ai["accuracy"]
    rows = F.array(
        entry("human", human, n_human),
        entry("ai", ai, n_ai),
        entry("accuracy", dict.fromkeys(names, accuracy), n_ai + n_human),
        entry("macro avg", {m: (human[m] + ai[m]) / 2.0 for m in names}, n_ai + n_human),
        entry(
            "weighted avg",
            {m: ratio(human[m] * n_human + ai[m] * n_ai, n_ai + n_human) for m in names},
            n_ai + n_human,
        ),
    )
    return counts.select(*keys, F.inline(rows))


def roc_curve(pred: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, fpr, tpr) at distinct scores without collinear points; starts at (0, 0), threshold null."""
    if not keys:
        return roc_curve(pred.withColumn("_all", F.lit(0)), ["_all"], y, p).drop("_all")
    keys = list(keys)
    running = _running(pred, keys, y, p, following=["pos", "neg"])
    totals = running.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    start = totals.select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    joined = join_keys(running, totals, keys, small=True)
    # A point is kept where the step into it differs from the step out of it; so are both ends.
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    last = F.col("next_pos").isNull()
    bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    points = joined.where(last | bend | first).select(
        *keys,
        F.col("score").alias("threshold"),
        ratio(F.col("fp"), F.col("_n")).alias("fpr"),
        ratio(F.col("tp"), F.col("_p")).alias("tpr"),
    )
    return start.unionByName(points)


def pr_curve(pred: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, precision, recall) at every distinct score and the closing point (1, 0), threshold null."""
    if not keys:
        return pr_curve(pred.withColumn("_all", F.lit(0)), ["_all"], y, p).drop("_all")
    keys = list(keys)
    running = _running(pred, keys, y, p)
    totals = running.groupBy(*keys).agg(F.sum("pos").alias("_p"))
    end = totals.select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    joined = join_keys(running, totals, keys, small=True)
    points = joined.select(
        *keys,
        F.col("score").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("_p"), 1.0).alias("recall"),
    )
    return points.unionByName(end)


def metric_rows(
    pred: DataFrame, keys: Sequence[str] = (), y: str = "y", p: str = "p", threshold: float = 0.5, digits: int | None = 5
) -> DataFrame:
    """All six metrics, one row per experiment, in one aggregate over the counts per score."""
    running = _running(pred, list(keys), y, p)
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    hit = F.col("score") >= threshold
    sums = running.groupBy(*keys).agg(
        F.sum(F.when(hit, pos).otherwise(0.0)).alias("_tp"),
        F.sum(F.when(hit, neg).otherwise(0.0)).alias("_fp"),
        F.sum(pos).alias("_p"),
        F.sum(neg).alias("_n"),
        # Pairs ranked right, ties for one half.
        F.sum(neg * (tp - pos / 2.0)).alias("_pairs"),
        F.sum(pos * tp / (tp + fp)).alias("_steps"),
    )
    c_tp, c_fp, c_p, c_n = (F.col(c) for c in ("_tp", "_fp", "_p", "_n"))
    m = classification_metrics(c_tp, c_fp, c_p - c_tp, c_n - c_fp)
    m["auc_roc"] = ratio(F.col("_pairs"), c_p * c_n)
    m["ap"] = ratio(F.col("_steps"), c_p)
    shown = {k: F.round(v, digits) if digits is not None else v for k, v in m.items()}
    return sums.select(*keys, *[v.alias(k) for k, v in shown.items()], (c_p + c_n).cast("bigint").alias("n_rows"))


def prevalence(pred: DataFrame, keys: Sequence[str] = (), y: str = "y") -> DataFrame:
    return pred.groupBy(*keys).agg(F.avg(F.col(y).cast("double")).alias("prevalence"))
