"""Fold changes and bootstrap p-values of groups of lineages against controls."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTROL, CHUNK = "control", 100_000


class NotUniqueError(ValueError):
    pass


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise NotUniqueError(f"{what}: rows with equal {list(keys)}")


def with_category(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Inner join, many to one."""
    keys = [c for c in categories.columns if c != "category"]
    require_unique(categories, keys, "categories")
    return df.join(categories, keys)


def group_statistics(df: DataFrame, column: str, group_by: Sequence[str]) -> DataFrame:
    """teststatistic (mean log2), foldchange (less the controls' mean) and lineages by group."""
    controls = df.filter(F.col("category") == CONTROL).agg(F.avg(F.log2(column)).alias("_control"))
    out = df.groupBy(*group_by).agg(F.avg(F.log2(column)).alias("teststatistic"), F.count(F.lit(1)).alias("lineages"))
    out = out.crossJoin(F.broadcast(controls))  # one row
    return out.withColumn("foldchange", F.col("teststatistic") - F.col("_control")).drop("_control")


def bootstrap_share(controls: np.ndarray, values: np.ndarray, n: int, draws: int, seed: int, counts: np.ndarray | None = None) -> np.ndarray:
    """Share of means of n drawn controls that are under each value; drawn in chunks of bounded size.

    controls: values, rising; counts: how many controls have each, one if not given."""
    rng = np.random.default_rng([seed, n])
    ends = np.cumsum(np.ones(len(controls), np.int64) if counts is None else counts)
    under, left = np.zeros(len(values)), draws
    while left:
        m = min(left, max(1, CHUNK * 10 // n))
        drawn = controls[np.searchsorted(ends, rng.integers(0, ends[-1], (m, n)), side="right")]
        means = np.sort(drawn.mean(1))
        under += np.searchsorted(means, values, side="left")
        left -= m
    return under / draws


def pvalues(df: DataFrame, column: str, group_by: Sequence[str], draws: int = 1_000_000, max_n: int = 950, seed: int = 0) -> DataFrame:
    """One-sided (lower tail) p-values; df has category. A group of n lineages is compared with means of
    min(n, max_n) controls. The null is made once for each such n, one task per n.

    Of the controls their histogram goes to the executors: a row for each different value of
    column, which are counts of reads, so it hardly grows with the number of controls."""
    stats = group_statistics(df, column, group_by).withColumn("_n", F.least(F.col("lineages"), F.lit(max_n)).cast("int"))
    bars = df.filter(F.col("category") == CONTROL).groupBy(F.log2(column).alias("v")).agg(F.count(F.lit(1)).alias("n")).filter("v is not null").toPandas().sort_values("v")
    if not len(bars):
        raise ValueError("no row has category 'control'")
    shared = df.sparkSession.sparkContext.broadcast((bars["v"].to_numpy(float), bars["n"].to_numpy(np.int64)))

    def share(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return part.assign(pvalue=bootstrap_share(shared.value[0], part["teststatistic"].to_numpy(), int(key[0]), draws, seed, shared.value[1]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields) + ", pvalue double"
    return stats.groupBy("_n").applyInPandas(share, schema).select("pvalue", "teststatistic", "foldchange", "lineages", *group_by)


def exact_single(df: DataFrame, column: str) -> DataFrame:
    """Exact p-values of single lineages: the share of controls under each value.

    By counts of distinct control values and running sums, not by comparing all pairs."""
    values = df.select(F.round(F.log2(column), 9).alias("value"), (F.col("category") == CONTROL).cast("long").alias("_is"))
    by = values.groupBy("value").agg(F.sum("_is").alias("_c"))
    before = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)  # distinct read counts only
    whole = by.agg(F.sum("_c").alias("_all"))
    return by.withColumn("_under", F.coalesce(F.sum("_c").over(before), F.lit(0))).crossJoin(F.broadcast(whole)).select("value", (F.col("_under") / F.col("_all")).alias("pvalue"))


def category_results(results: DataFrame, categories: DataFrame) -> DataFrame:
    """Results with their category, one to one."""
    keys = [c for c in categories.columns if c != "category"]
    if bad := [k for k in keys if k not in results.columns]:
        raise ValueError(f"categories by {bad}, which results are not grouped by")
    require_unique(categories, keys, "categories")
    require_unique(results, keys, "results")
    return results.join(categories, keys)


__all__ = ["NotUniqueError", "bootstrap_share", "category_results", "exact_single", "group_statistics", "pvalues", "with_category"]
