"""Cutting lineage between rounds of an iteration."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; local sessions may lack it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file:///tmp/loomgraph-checkpoints"
    return f"{base.rstrip('/')}/graph/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back; survives the loss of executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has Spark drop the shuffle files of finished work, which go once neither Python nor the JVM refers to their plans."""
    gc.collect()
    spark._jvm.System.gc()
