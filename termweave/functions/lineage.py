"""Cutting lineage in loops, by files that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session may lack it, and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="termweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A path in the scratch folder that nothing has yet."""
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the scratch folder and read again: lineage ends here, as with a checkpoint, and what reads it
    later has columns to prune, filters to push and sizes to plan by."""
    path = scratch_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
