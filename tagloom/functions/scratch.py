"""Tables written to the shared checkpoint folder to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one temporary folder per process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tagloom-core-"))
    return _own[0]


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """df, computed once and read back; it outlives executors and its plan is a scan."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
