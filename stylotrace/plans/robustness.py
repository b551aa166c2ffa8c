"""The robustness experiment: methods by scenarios, and how quality falls from the home scenario."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stylotrace.operators.evaluate import metric_rows
from stylotrace.operators.ordering import hash_rank
from stylotrace.operators.stats import box_summary

PIVOT_METRICS = ["f1", "auc_roc", "accuracy"]


def evaluate_scenarios(pred: DataFrame, scenario: str = "scenario", method: str = "method") -> DataFrame:
    """Metric rows of every method in every scenario, all in one job."""
    return metric_rows(pred, [scenario, method])


def pivot_metrics(rows: DataFrame, scenarios: Sequence[str], metrics: Sequence[str] = PIVOT_METRICS) -> DataFrame:
    """One row per method, one column per metric and scenario (``<scenario>_<metric>``)."""
    wide = rows.groupBy("method").pivot("scenario", list(scenarios))
    return wide.agg(*[F.first(F.round(m, 4)).alias(m) for m in metrics])


def degradation(rows: DataFrame, home: str, metrics: Sequence[str] = ("f1",)) -> DataFrame:
    """Each metric minus the method's value in the home scenario."""
    base = rows.where(F.col("scenario") == home).select("method", *[F.col(m).alias(f"home_{m}") for m in metrics])
    joined = rows.join(base, "method")
    return joined.select(
        "scenario", "method", *metrics, *[(F.col(m) - F.col(f"home_{m}")).alias(f"delta_{m}") for m in metrics]
    )


def rank_methods(rows: DataFrame, by: str = "f1") -> DataFrame:
    """Methods of each scenario, best first."""
    order = Window.partitionBy("scenario").orderBy(F.desc(by), "method")  # one row per method
    return rows.withColumn("place", F.row_number().over(order))


def auc_profile(rows: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    return rows.groupBy("method").pivot("scenario", list(scenarios)).agg(F.first("auc_roc"))


def feature_stability(
    home: DataFrame, shifted: DataFrame, features: Sequence[str], label: str = "y", sample: int | None = None, id_col: str = "doc_id"
) -> DataFrame:
    """Feature ranges by (domain, class), of all rows.

    With ``sample``, of that many drawn rows of the home domain against as many first shifted rows.
    """
    if sample is not None:
        home = hash_rank(home, id_col, [], limit=F.lit(sample))
        shifted = shifted.orderBy(id_col).limit(sample)
    columns = [label, *features]
    both = [df.select(*columns).withColumn("domain", F.lit(name)) for name, df in (("home", home), ("shifted", shifted))]
    return box_summary(both[0].unionByName(both[1]), ["domain", label], features)


def final_report(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc("accuracy"), "experiment")
