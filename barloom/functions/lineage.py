"""Cutting lineage where a derived table is read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder; a temporary one only in a local session that names none.

    On a cluster a folder of one machine would be invisible to the others, so a session without a shared folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='barloom-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/barloom-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back, the same way in every session; it outlives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
