"""Correcting random barcodes: Hamming links, unique roots, re-aggregation.

At a level of the hierarchy, tags with the same prefix of upper barcodes are linked if
they differ in at most k places, from the one with fewer reads to the one with more (ties:
the greater tag is the parent). A tag whose ancestors end in one root becomes that root;
one with several distinct roots is ambiguous and goes with its reads.

The link search is an equi-join on keys of the tag (see ``link_keys``): for one error in a
short tag, the tag with a letter masked; else k + 1 pieces, of which tags within k errors
share one. Roots are found by passing smallest and largest root down the links until
nothing changes; a tag is unambiguous if both are the same. Each round is written, so a
lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.config import Barcode
from tagloom.functions.scratch import written
from tagloom.functions.sequences import hamming, link_keys
from tagloom.operators.combos import deduplicate, remove_ambiguous


def links(counts: DataFrame, prefix: Sequence[str], tag: str, k: int = 1, bands: dict[str, int] | None = None) -> DataFrame:
    """child and parent (prefix..., child, parent) of counts (prefix..., tag, reads).

    bands: further columns and how far apart they may be, such as a read's start and end;
    a banded column joins on its bucket and the next ones."""
    prefix = list(prefix)
    bands = bands or {}
    base = counts.select("*", F.posexplode(link_keys(F.col(tag), k)).alias("_at", "_piece"))
    base = base.withColumn("_length", F.length(tag))
    keys = [*prefix, "_length", "_at", "_piece"]
    child = base.select(*keys, F.col(tag).alias("child"), F.col("reads").alias("_nc"), *[F.col(b).alias(f"_c_{b}") for b in bands])
    parent = base.select(*keys, F.col(tag).alias("parent"), F.col("reads").alias("_np"), *[F.col(b).alias(f"_p_{b}") for b in bands])
    for b, far in bands.items():
        child = child.withColumn(f"_b_{b}", F.explode(F.array(*[F.floor(F.col(f"_c_{b}") / (far + 1)) + i for i in ((-1, 0, 1) if far else (0,))])))
        parent = parent.withColumn(f"_b_{b}", F.floor(F.col(f"_p_{b}") / (far + 1)))
        keys.append(f"_b_{b}")
    pairs = child.join(parent, keys)
    rank = lambda n, t, s: F.struct(F.col(n), *[F.col(f"_{s}_{b}") for b in bands], F.col(t))
    pairs = pairs.filter((rank("_np", "parent", "p") > rank("_nc", "child", "c")) & (hamming(F.col("child"), F.col("parent")) <= k))
    for b, far in bands.items():
        pairs = pairs.filter(F.abs(F.col(f"_c_{b}") - F.col(f"_p_{b}")) <= far)
    return pairs.select(*prefix, "child", "parent").distinct()


def roots(counts: DataFrame, edges: DataFrame, prefix: Sequence[str], tag: str) -> DataFrame:
    """prefix..., tag, first_root and last_root of every tag; the same if it has one root."""
    prefix = list(prefix)
    edges = written(edges, "links")
    state = counts.select(*prefix, tag).distinct().join(edges.select(*prefix, F.col("child").alias(tag)).distinct().withColumn("_inner", F.lit(True)), [*prefix, tag], "left")
    own = F.when(F.col("_inner").isNull(), F.col(tag))
    state = written(state.select(*prefix, tag, own.alias("lo"), own.alias("hi")), "roots")
    while True:
        up = state.select(*prefix, F.col(tag).alias("parent"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        given = edges.join(up, [*prefix, "parent"]).groupBy(*prefix, F.col("child").alias(tag)).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        new = state.join(given, [*prefix, tag], "left").select(*prefix, tag, F.least("lo", "_lo").alias("_l"), F.greatest("hi", "_hi").alias("_h"), "lo", "hi")
        new = written(new.select(*prefix, tag, F.col("_l").alias("lo"), F.col("_h").alias("hi"), (~F.col("_l").eqNullSafe(F.col("lo")) | ~F.col("_h").eqNullSafe(F.col("hi"))).alias("_moved")), "roots")
        done = new.filter("_moved").isEmpty()
        state = new.drop("_moved")
        if done:
            return state.select(*prefix, tag, F.col("lo").alias("first_root"), F.col("hi").alias("last_root"))


def corrections(counts: DataFrame, prefix: Sequence[str], tag: str, k: int = 1) -> DataFrame:
    """prefix..., tag and root of the unambiguous tags."""
    edges = links(counts, prefix, tag, k)
    return roots(counts, edges, prefix, tag).filter(F.col("first_root") == F.col("last_root")).select(*prefix, tag, F.col("first_root").alias("root"))


def apply_corrections(df: DataFrame, fixed: DataFrame, prefix: Sequence[str], tag: str) -> DataFrame:
    """Tags by their roots, rows of ambiguous tags dropped, reads summed again."""
    out = df.join(fixed, [*prefix, tag]).withColumn(tag, F.col("root")).select(*df.columns)
    return deduplicate(out)


def correct_level(df: DataFrame, prefix: Sequence[str], tag: str, k: int = 1) -> DataFrame:
    if k == 0:
        return deduplicate(df)
    counts = written(df.groupBy(*prefix, tag).agg(F.sum("reads").alias("reads")), "counts")
    return apply_corrections(df, corrections(counts, prefix, tag, k), prefix, tag)


def error_correct(df: DataFrame, hierarchy: list[Barcode], k: int = 1, drop_ambiguous: bool = False) -> DataFrame:
    """Every random level from the top down, each within the corrected barcodes above it."""
    prefix: list[str] = []
    for b in hierarchy:
        if not b.is_reference:
            df = written(correct_level(df, prefix, b.name, k), "level")
        prefix.append(b.name)
    return remove_ambiguous(df, hierarchy) if drop_ambiguous else df
