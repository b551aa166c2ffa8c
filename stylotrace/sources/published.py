"""Tables that are replaced or extended while others read them.

Every write goes to a folder of its own. Only when it is complete is a row about it added to the table's manifest
(version, folder, number of rows), in one small file that appears at once. Readers look at the manifest alone: a folder
that was never finished is in no row, and a version that was written twice, as a restarted batch is, counts once.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, folder string, n_rows long, columns array<string>"


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """One row per version that is complete: (version, folder, n_rows, columns). Empty if nothing was published."""
    base = base.rstrip("/")
    try:
        rows = spark.read.schema(MANIFEST).json(f"{base}/manifest")
    except AnalysisException:  # no manifest yet
        return spark.createDataFrame([], MANIFEST)
    whole = F.struct("folder", "n_rows", "columns")
    rows = rows.where("folder IS NOT NULL").groupBy("version").agg(F.max(whole).alias("_f"))
    return rows.select("version", F.concat(F.lit(f"{base}/"), "_f.folder").alias("folder"), "_f.n_rows", "_f.columns")


def publish(df: DataFrame, base: str, version: int | None = None) -> int:
    """Write ``df`` as a version of the table at ``base`` (the next one, if none is given) and return its number."""
    spark, base = df.sparkSession, base.rstrip("/")
    if version is None:
        version = 1 + (manifest(spark, base).agg(F.max("version")).first()[0] or 0)
    folder = f"data/{version:08d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{folder}")
    written = spark.read.schema(df.schema).parquet(f"{base}/{folder}")
    row = [(version, folder, written.count(), df.columns)]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(f"{base}/manifest")
    return version


def _read(spark: SparkSession, rows: list) -> DataFrame | None:
    return spark.read.parquet(*[r["folder"] for r in rows]) if rows else None


def latest(spark: SparkSession, base: str) -> DataFrame | None:
    """The newest complete version; None if there is none."""
    return _read(spark, manifest(spark, base).orderBy(F.desc("version")).limit(1).collect())


def all_versions(spark: SparkSession, base: str) -> DataFrame | None:
    """The rows of all complete versions together; None if there is none."""
    return _read(spark, manifest(spark, base).orderBy("version").collect())  # one row per version
