"""Tables that cut lineage in loops: written to the shared folder, so lost executors cost a re-read only."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where that is unset (local runs)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all of it shares")
        base = getattr(spark.sparkContext, "_tributary_folder", None)
        if not base:
            base = spark.sparkContext._tributary_folder = "file://" + tempfile.mkdtemp(prefix="tributary-")
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
