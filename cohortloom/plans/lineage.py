"""Cutting lineage on shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return configured


def set_own_dir(spark: SparkSession, path: str) -> None:
    """Name a folder in a session that names none, for local runs; sessions guard this setting against late changes."""
    guard = "spark.sql.legacy.setCommandRejectsSparkCoreConfs"
    before = spark.conf.get(guard)
    spark.conf.set(guard, "false")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.conf.set(guard, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
