"""Tables that later jobs pick up again: features, runs."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylotrace.sources.published import manifest, publish

FEATURE_VERSION = 1


def fingerprint(df: DataFrame, columns: Sequence[str]) -> str:
    """Order-free fingerprint over all rows: count, sum and xor of row hashes."""
    h = F.xxhash64(*columns)
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")
    ).first()
    return f"{row['n']}-{int(row['s'] or 0) & (2**64 - 1):016x}-{(row['x'] or 0) & (2**64 - 1):016x}"


def feature_store(
    df: DataFrame,
    base: str,
    tag: str,
    compute: Callable[[DataFrame], DataFrame],
    features: Sequence[str],
    key: Sequence[str] = ("doc_id", "text"),
    version: int = FEATURE_VERSION,
) -> DataFrame:
    """Features of exactly these rows: read when stored and complete, else computed and stored."""
    spark = df.sparkSession
    path = f"{base.rstrip('/')}/{tag}/v{version}/{fingerprint(df, list(key))}"
    for _ in range(2):
        held = manifest(spark, path).orderBy(F.desc("version")).limit(1).collect()
        if held and set(features) <= set(held[0]["columns"]):
            return spark.read.parquet(held[0]["folder"])
        publish(compute(df), path)
    raise ValueError(f"the job does not compute all of {list(features)}")


def _replace_partition(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment").parquet(path)


def save_run(base: str, experiment: str, metrics: DataFrame, predictions: DataFrame) -> None:
    """Store one experiment's metrics and predictions; saving it again replaces them."""
    name = F.lit(experiment)
    _replace_partition(metrics.withColumn("experiment", name), f"{base}/metrics")
    _replace_partition(predictions.withColumn("experiment", name), f"{base}/predictions")


def load_runs(spark: SparkSession, base: str, experiments: dict[str, str] | Iterable[str]) -> DataFrame:
    """Metrics of the listed experiments that were stored; the others are named in a warning."""
    labels = experiments if isinstance(experiments, dict) else {e: e for e in experiments}
    wanted = spark.createDataFrame(list(labels.items()), "experiment string, name string")
    try:
        stored = spark.read.parquet(f"{base}/metrics")
    except AnalysisException:  # nothing was stored yet
        warnings.warn(f"runs not found: {', '.join(sorted(labels))}", stacklevel=2)
        return wanted.limit(0)
    stored = stored.withColumn("experiment", F.col("experiment").cast("string")).drop("name")
    present = stored.withColumn("_stored", F.lit(True))
    joined = wanted.join(present, "experiment", "left")
    missing = [r["experiment"] for r in joined.where("_stored is null").select("experiment").collect()]
    if missing:
        warnings.warn(f"runs not found: {', '.join(sorted(missing))}", stacklevel=2)
    return joined.where("_stored").drop("_stored")


def load_predictions(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/predictions")
