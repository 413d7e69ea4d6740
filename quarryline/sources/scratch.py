"""The folder that driver and executors share for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def scratch_path(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="quarryline-")
    return _LOCAL[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what is used several times is made once,
    and survives the loss of an executor."""
    path = f"{scratch_path(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
