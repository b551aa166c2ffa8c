"""Session construction for local runs, and the one place that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "stylotrace", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STYLOTRACE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach, below the session's checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` has to name shared storage. Only a local session may fall
    back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    unique = uuid.uuid4().hex[:16]
    if base:
        return f"{base.rstrip('/')}/{purpose}-{unique}"
    if not _local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix=f"stylotrace-{purpose}-")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage once and continue from there.

    Used where several later jobs depend on the same rows: they neither recompute them nor can they
    see different rows after an executor is lost.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(base or shared_dir(spark, "checkpoint"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, id_col: str) -> DataFrame:
    """Give every core work when the input has fewer splits than there are cores; else leave it alone.

    Only for jobs whose cost per row is high next to moving the row once. Inputs of cluster size have
    more splits than cores and are never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, id_col) if df.rdd.getNumPartitions() < cores else df
