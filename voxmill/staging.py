"""Tables that are worked out once: written to a folder that all executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share: under ``spark.checkpoint.dir``, or a local one on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="voxmill-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Written to the shared folder and read back: worked out once, however often it is used. ``by`` names columns that cut it into folders."""
    path = folder(df.sparkSession)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
