"""Seeded samples and splits drawn by hash order, so they are repeatable at any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stylotrace.fixed_values import SEED
from stylotrace.operators.ordering import hash_rank


def sample_per_class(df: DataFrame, id_col: str, label: str, n: int, seed: int = SEED) -> DataFrame:
    """min(n, class size) rows of every class, without replacement."""
    return hash_rank(df, id_col, [label], seed, limit=F.lit(n)).drop("_rank", "_total")


def balanced_sample(df: DataFrame, id_col: str, label: str, cap: int, seed: int = SEED) -> DataFrame:
    """Every class cut to the smallest class size, or to ``cap`` if that is less."""
    sizes = df.groupBy(label).count().agg(F.min("count").alias("smallest")).first()
    n = min(cap, sizes["smallest"] or 0)
    return sample_per_class(df, id_col, label, n, seed)


def shuffle_with_ids(df: DataFrame, id_col: str, seed: int = SEED, out: str = "id") -> DataFrame:
    """Number the rows 0..n-1 in hash order."""
    ranked = hash_rank(df, id_col, [], seed)
    return ranked.withColumn(out, F.col("_rank") - 1).drop("_rank", "_total")


def stratified_split(
    df: DataFrame, id_col: str, label: str, test_share: float = 0.2, seed: int = SEED
) -> DataFrame:
    """Add ``split``: round(test_share * class size) rows of each class are ``test``, the rest ``train``."""
    ranked = hash_rank(df, id_col, [label], seed)
    is_test = F.col("_rank") <= F.round(F.col("_total") * test_share)
    return ranked.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("_rank", "_total")


def stratified_kfold(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """Add ``fold`` 0..k-1, each class dealt out in turns."""
    ranked = hash_rank(df, id_col, [label], seed)
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank", "_total")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * n_class) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    everything = Window.partitionBy(F.lit(1))  # one row per class
    n, k = F.sum("n_class").over(everything), F.count(F.lit(1)).over(everything)
    return counts.select(label, "n_class", (n / (k * F.col("n_class"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Add the weight of each row's class; null labels are a class of their own."""
    weights = class_weights(df, label).select(F.col(label).alias("_class"), F.col("weight").alias(out))
    return df.join(F.broadcast(weights), F.col(label).eqNullSafe(F.col("_class"))).drop("_class")  # one row per class
