"""Exact counts of combinations over a stream: counting is commutative, so they equal the batch's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.scratch import folder


def count(stream: DataFrame, names: list[str]) -> DataFrame:
    """For output mode complete or update."""
    return stream.groupBy(*names).agg(F.count(F.lit(1)).alias("reads"))


def write_counts(stream: DataFrame, names: list[str], path: str, checkpoint: str):
    """A running query that keeps the counts so far as one Parquet folder for each batch.

    A batch that is run again after a failure replaces its own folder."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return count(stream, names).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put)


def run_once(spark: SparkSession, path: str) -> DataFrame:
    """Stream what there is of a table of line items through the counts; returns the last batch."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path).select(F.col("l_returnflag").alias("sample"), F.col("l_linenumber").alias("lane"))
    base = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    q = write_counts(stream, ["sample", "lane"], f"{base}/out", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    last = out.agg(F.max("batch")).first()[0]
    return out.filter(F.col("batch") == last).drop("batch")
