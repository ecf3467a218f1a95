"""From reads to counted barcode combinations: extract, filter, correct, count."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.config import Barcode
from tagloom.functions.scratch import written
from tagloom.functions.sequences import group_numbers, hamming, is_plain, stem, to_java


def extract(reads: DataFrame, regexes: dict[str, str], names: list[str]) -> DataFrame:
    """Adds a column for each barcode in names from the tag columns that have a pattern.

    The groups of a barcode (its name, with digits behind or not) are joined in order of
    their names, a bare name counting as name0; of equal names the later tag's wins, and
    a group that did not match is empty. Patterns that the JVM knows run there; fuzzy ones
    run in an Arrow function."""
    plain = {t: p for t, p in regexes.items() if is_plain(p)}
    found: dict[str, Column] = {}
    out = reads
    if fuzzy := {t: p for t, p in regexes.items() if t not in plain}:
        out = _fuzzy(out, fuzzy)
    for tag, p in regexes.items():
        if tag in plain:
            for name, i in group_numbers(p).items():
                found[_numbered(name)] = F.regexp_extract(F.coalesce(F.col(tag), F.lit("")), to_java(p), i)
        else:
            for name in _fuzzy_names(p):
                found[_numbered(name)] = F.coalesce(F.col("_fuzzy")[name], F.lit(""))
    parts = lambda n: [found[k] for k in sorted(found) if stem(k) == n]
    out = out.withColumns({n: F.concat(*p) if (p := parts(n)) else F.lit("") for n in names})
    return out.drop("_fuzzy")


def _numbered(name: str) -> str:
    return name if name[-1].isdigit() else name + "0"


def _fuzzy_names(pattern: str) -> list[str]:
    import regex

    return list(regex.compile(pattern).groupindex)


def _fuzzy(reads: DataFrame, patterns: dict[str, str]) -> DataFrame:
    tags = list(patterns)
    names = [n for p in patterns.values() for n in _fuzzy_names(p)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys(names)])

    def run(*columns: pd.Series) -> pd.DataFrame:
        import regex

        compiled = [regex.compile(patterns[t]) for t in tags]
        rows = []
        for values in zip(*columns, strict=True):
            row: dict[str, str] = {}
            for p, v in zip(compiled, values, strict=True):
                if v is not None and (m := p.search(v)):
                    row |= m.groupdict()
            rows.append([row.get(n) or "" for n in schema.names])
        return pd.DataFrame(rows, columns=schema.names)

    return reads.withColumn("_fuzzy", F.pandas_udf(run, schema)(*[F.col(t) for t in tags]))


def missing(hierarchy: list[Barcode]) -> Column:
    """Why a read is rejected before its length is looked at: a barcode is empty."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.length(b.name), F.lit(0)) == 0, F.lit(b.name)) for b in hierarchy]))


def too_short(hierarchy: list[Barcode]) -> Column:
    return F.array_compact(F.array(*[F.when(F.length(b.name) < b.min_length, F.lit(f"{b.name}_length")) if b.min_length else F.lit(None).cast("string") for b in hierarchy]))


def truncate(df: DataFrame, hierarchy: list[Barcode]) -> DataFrame:
    return df.withColumns({b.name: F.substring(b.name, 1, b.max_length) for b in hierarchy if b.max_length})


def reference_name(barcode: Column, references: tuple[tuple[str, str], ...], threshold: float) -> Column:
    """Name of the reference that is equal, else of the first within the threshold, else null."""
    listed = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(n).alias("n")) for s, n in references])
    equal = F.get(F.filter(listed, lambda r: r["s"] == barcode), F.lit(0))["n"]
    near = F.filter(listed, lambda r: hamming(barcode, r["s"]) <= int(threshold)) if not math.isinf(threshold) else listed
    return F.coalesce(equal, F.get(near, F.lit(0))["n"])


def correct_references(counted: DataFrame, hierarchy: list[Barcode]) -> DataFrame:
    """Reference barcodes by their names, null where none is near; each distinct barcode is looked up once."""
    out = counted
    for b in hierarchy:
        if b.is_reference:
            if not b.references:
                out = out.withColumn(b.name, F.lit(None).cast("string"))
                continue
            looked = out.select(b.name).distinct().withColumn("_name", reference_name(F.col(b.name), b.references, b.threshold))
            out = out.join(looked, b.name, "left").withColumn(b.name, F.col("_name")).drop("_name")
    return out.select(*counted.columns)


def demultiplex(reads: DataFrame, hierarchy: list[Barcode], regexes: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Combinations (one column for each barcode, reads) and statistics (kind, barcode, value, reads).

    Reads are counted by raw barcodes first, so lengths and references are looked at once
    for each distinct combination."""
    names = [b.name for b in hierarchy]
    # written: else filters move below the count, where each would run the expressions on every read again
    raw = written(extract(reads, regexes, names).groupBy(*names).agg(F.count(F.lit(1)).alias("reads")), "raw")
    short = F.when(F.size("_missing") == 0, too_short(hierarchy)).otherwise(F.array().cast("array<string>"))
    seen = raw.withColumn("_missing", missing(hierarchy)).withColumn("_short", short)
    good = truncate(seen.filter((F.size("_missing") == 0) & (F.size("_short") == 0)).select(*names, "reads"), hierarchy)
    fixed = correct_references(good, hierarchy)
    failed = F.array_compact(F.array(*[F.when(F.col(b.name).isNull(), F.lit(f"{b.name}_correction_failed")) for b in hierarchy if b.is_reference])) if any(b.is_reference for b in hierarchy) else F.array().cast("array<string>")
    fixed = fixed.withColumn("_failed", failed)
    kept = fixed.filter(F.size("_failed") == 0)
    combos = kept.groupBy(*names).agg(F.sum("reads").alias("reads"))
    return combos, _statistics(seen, fixed, kept, hierarchy)


def _statistics(seen: DataFrame, fixed: DataFrame, kept: DataFrame, hierarchy: list[Barcode]) -> DataFrame:
    row = lambda d, kind, barcode, value: d.groupBy(F.lit(kind).alias("kind"), barcode.alias("barcode"), value.alias("value")).agg(F.sum("reads").alias("reads"))
    none = F.lit(None).cast("string")
    parts = [
        row(seen, "processed", none, none),
        row(kept, "remaining", none, none),
        row(seen.select("reads", F.explode(F.concat("_missing", "_short")).alias("r")), "failed", none, F.col("r")),
        row(fixed.select("reads", F.explode("_failed").alias("r")), "failed", none, F.col("r")),
        *[row(kept, "success", F.lit(b.name), F.col(b.name)) for b in hierarchy if b.is_reference],
    ]
    return reduce(DataFrame.unionByName, parts)
