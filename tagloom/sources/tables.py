"""Tables in and out: CSV and Parquet, JSON statistics."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class UnknownFileType(ValueError):
    pass


def read_table(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """CSV (with a header; strings unless inferred) or Parquet, by the name's end; unsigned reads become bigint."""
    if path.endswith((".csv", ".tsv")):
        return spark.read.csv(path, header=True, sep="\t" if path.endswith("tsv") else ",", inferSchema=infer)
    if path.endswith(".parquet"):
        d = spark.read.parquet(path)
        return d.withColumns({f.name: F.col(f.name).cast("long") for f in d.schema.fields if f.dataType.simpleString() == "decimal(20,0)"})
    raise UnknownFileType(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """A folder of Parquet files."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder with one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def to_csv(spark: SparkSession, source: str, target: str | None = None) -> str:
    target = target or str(Path(source).with_suffix(".csv"))
    write_csv(read_table(spark, source), target)
    return target


def to_parquet(spark: SparkSession, source: str, target: str | None = None) -> str:
    target = target or str(Path(source).with_suffix(".parquet"))
    write_parquet(read_table(spark, source, infer=True), target)
    return target


def write_json(value: object, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=1))
