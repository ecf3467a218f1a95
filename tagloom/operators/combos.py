"""Operators on tables of barcode combinations with a column of reads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.config import Barcode, ConfigError
from tagloom.functions.sequences import is_ambiguous


def barcodes(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "reads"]


def combine(tables: Sequence[DataFrame]) -> DataFrame:
    """Union of tables with reads summed; the full-outer merge of counters."""
    whole = reduce(DataFrame.unionByName, tables)
    return whole.groupBy(*barcodes(whole)).agg(F.sum("reads").alias("reads"))


def deduplicate(df: DataFrame) -> DataFrame:
    return df.groupBy(*barcodes(df)).agg(F.sum("reads").alias("reads"))


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("combinations"), F.coalesce(F.sum("reads"), F.lit(0)).alias("reads"))


def remove_ambiguous(df: DataFrame, hierarchy: list[Barcode]) -> DataFrame:
    """Drops rows whose random barcodes hold a letter that stands for several bases."""
    bad = [is_ambiguous(F.col(b.name)) for b in hierarchy if not b.is_reference and b.name in df.columns]
    return df.filter(~reduce(lambda a, b: a | b, bad)) if bad else df


def threshold(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows with reads >= threshold. limits: threshold alone (its first row counts) or with barcode columns.

    With barcodes the join is inner: a combination without a limit goes."""
    keys = [c for c in limits.columns if c != "threshold"]
    if "threshold" not in limits.columns:
        raise ConfigError("thresholds have no column 'threshold'")
    if unknown := [c for c in keys if c not in df.columns]:
        raise ConfigError(f"thresholds by {unknown}, which the table does not have")
    if not keys:
        first = limits.select(F.col("threshold").cast("long").alias("threshold")).limit(1)
        return df.crossJoin(F.broadcast(first)).filter("reads >= threshold").select(*df.columns)  # one row
    return df.join(limits.withColumn("threshold", F.col("threshold").cast("long")), keys).filter("reads >= threshold").select(*df.columns)


def jaccard(df: DataFrame, barcode: str, lid: str = "lid") -> DataFrame:
    """Likeness of any two values of a barcode by their distinct lineages, in both orders; those without any in common are absent."""
    pairs = df.select(lid, barcode).distinct()
    size = pairs.groupBy(barcode).agg(F.count(F.lit(1)).alias("n"))
    a = pairs.select(lid, F.col(barcode).alias("a"))
    b = pairs.select(lid, F.col(barcode).alias("b"))
    both = a.join(b, lid).filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    out = both.join(size.select(F.col(barcode).alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col(barcode).alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def overlap(df: DataFrame, barcode: str, lids: Sequence[str], groups: dict[str, str] | None = None) -> DataFrame:
    """Adds overlap: a row's reads as a share of the largest of its lineage; 1.0 for that row, 1.1 for rows of the same group as it.

    Ties go to the smaller barcode."""
    w = Window.partitionBy(*lids).orderBy(F.desc("reads"), F.asc(barcode))
    group = F.coalesce(F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])[F.col(barcode)], F.col(barcode)) if groups else F.col(barcode)
    d = df.withColumns({"_rank": F.row_number().over(w), "_reads": F.first("reads").over(w), "_group": group})
    d = d.withColumn("_top", F.first("_group").over(w))
    value = F.when(F.col("_rank") == 1, F.lit(1.0)).when(F.col("_group") == F.col("_top"), F.lit(1.1)).otherwise(F.col("reads") / F.col("_reads"))
    return d.withColumn("overlap", value).select(*df.columns, "overlap")


def overlap_removal(df: DataFrame, least: float) -> DataFrame:
    return df.filter(F.col("overlap") >= least)


def partition_bounds(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First place (from 0) and length of each key's rows in the table sorted by keys and order.

    Starts are running sums of counts by key, so no row is numbered one by one."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("length"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))


def zip_mates(tables: Sequence[tuple[str, DataFrame]], keys: Sequence[str] = ("group", "ordinal")) -> DataFrame:
    """Mate files joined place by place, each one's tags behind its prefix; ends with the shortest file."""
    named = [d.select(*keys, *[F.col(c).alias(p + c) for c in d.columns if c not in keys]) for p, d in tables]
    return reduce(lambda a, b: a.join(b, list(keys)), named)


def unhandled(calls: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Calls that have no result."""
    return calls.join(results.select(key).distinct(), key, "left_anti")
