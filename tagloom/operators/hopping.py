"""Index hopping: combinations that a binomial model explains are removed.

For a set of hopping barcodes, rows that agree in all other barcodes (the anchors) are a
group of n reads in c combinations, k of which have more than one read. A row must have
its own reads if c = 1, the upper alpha quantile of Binomial(n, 1/k) if k > 1, else the
group's largest count. Rows must reach the thresholds of all sets, each computed on the
unfiltered table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators.combos import barcodes


def binomial_isf(alpha: float, n: int, p: float) -> int:
    """The smallest j with P(X > j) <= alpha.

    Terms are summed from the top, within 12 standard deviations and 40 of the mean;
    what is outside is far under the accuracy of the sum."""
    if p >= 1:
        return n
    mean, sd = n * p, math.sqrt(n * p * (1 - p))
    low, high = max(0, int(mean - 12 * sd - 40)), min(n, int(mean + 12 * sd + 40))
    log = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)
    tail = 0.0
    for j in range(high, low, -1):
        tail += math.exp(log(j))  # P(X >= j) = P(X > j - 1)
        if tail > alpha:
            return j
    return low


def _anchors(keys: Sequence[str], hopping: Sequence[str]) -> list[str]:
    listed = [hopping] if isinstance(hopping, str) else list(hopping)
    return [b for b in keys if b not in listed]


def group_counts(df: DataFrame, hopping: Sequence[str], keys: Sequence[str] | None = None) -> DataFrame:
    """Anchors with n, c, k and most. keys: the barcodes, all columns but reads if not given."""
    return df.groupBy(*_anchors(keys or barcodes(df), hopping)).agg(
        F.sum("reads").alias("n"), F.count(F.lit(1)).alias("c"), F.coalesce(F.sum((F.col("reads") > 1).cast("long")), F.lit(0)).alias("k"), F.max("reads").alias("most")
    )


def thresholds(df: DataFrame, hopping: Sequence[str], alpha: float = 0.05, column: str = "hopping_threshold", keys: Sequence[str] | None = None) -> DataFrame:
    """df with the threshold of each row; a null barcode is a value like any other.

    The quantile is computed once for each (n, k) and partition of them."""
    keys = list(keys or barcodes(df))

    def quantile(n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([binomial_isf(alpha, int(a), 1 / int(b)) for a, b in zip(n, k, strict=True)], dtype="int64")

    isf = F.pandas_udf(quantile, "long")
    counts = group_counts(df, hopping, keys)
    needed = counts.filter("c > 1 and k > 1").select("n", "k").distinct().withColumn("_q", isf("n", "k"))
    counts = counts.join(needed, ["n", "k"], "left")
    value = F.when(F.col("_c") == 1, F.col("reads")).when(F.col("_k") > 1, F.col("_q")).otherwise(F.col("_most"))
    anchors = _anchors(keys, hopping)
    limits = counts.select(*[F.col(a).alias(f"_a_{a}") for a in anchors], F.col("c").alias("_c"), F.col("k").alias("_k"), F.col("most").alias("_most"), "_q")
    if anchors:
        joined = df.join(limits, reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(f"_a_{a}")) for a in anchors]))
    else:
        joined = df.crossJoin(F.broadcast(limits))  # one row
    return joined.withColumn(column, value.cast("long")).select(*df.columns, column)


def hopping_removal(df: DataFrame, sets: Sequence[Sequence[str]], alpha: float = 0.05) -> DataFrame:
    """Rows that reach the thresholds of all sets; the thresholds are carried along, each computed on all rows."""
    keys, out = barcodes(df), df
    limits = [f"_t{i}" for i in range(len(sets))]
    for s, limit in zip(sets, limits, strict=True):
        out = thresholds(out, s, alpha, limit, keys)
    return out.filter(reduce(lambda x, y: x & y, [F.col("reads") >= F.col(t) for t in limits], F.lit(True))).select(*df.columns)
