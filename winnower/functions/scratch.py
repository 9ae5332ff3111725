"""Tables in the folder that the cluster shares; they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where there is none, a temporary one on a single machine only."""
    global _own
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="winnower-")
    return _own


def new_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/winnower/{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table of their own; those that come from one already stay there."""
    if getattr(df, "_stored", False):
        return df
    path = f"{new_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stored = True
    return stored
