"""SpotSigs: document fingerprints from chains of content words after common words.

A text is lower-cased and split into runs of letters. Common words of four languages are
anchors; an anchor and the next ``CHAIN`` content words (common words skipped) make a
signature, a 40-bit hash. The set of signatures, sorted, is the fingerprint; a text
without one has the hash of all its words instead, so other texts of that kind differ.
All is DataFrame operations.

``fingerprints`` compares each document with its edited self and with the next one. Two
sets are like one another at a threshold t only if their sizes differ by a factor of t at
most: ``length_class`` partitions sets so that likes are in one class or in neighbours,
and ``similar`` decides by size alone before it intersects.

Finding the next document takes one shuffle of texts by ranges of doc_id; each range also
gets the head of the following one, so no text is sent to a single task. Ranges end at
quantiles of doc_id, ``RANGE_ROWS`` documents apart while there are ``MAX_RANGES`` at most,
so ids that lie in heaps fill ranges like any others.

Defined results: null text is empty; equal doc_ids are in order of their text; a null
doc_id comes first; the only row is its own next document; an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

CHAIN, HEX, PERCENT, RANGE_ROWS, MAX_RANGES = 2, 10, 80, 1000, 100_000
ANCHORS = sorted(
    set(
        "the of and to in a is that it for was on with as at by an be this from or are "
        "der die das und in den von zu mit ist im für auf des dem ein eine nicht sich auch "
        "le la les de des et en un une que qui dans pour est du au sur pas il elle par "
        "el los las y de que en un una con por para es se no su al lo como del".split()
    )
)


def _hash(x: Column) -> Column:
    return F.substring(F.md5(x.cast("binary")), 1, HEX)


def _with_signatures(d: DataFrame, **texts: str) -> DataFrame:
    """Adds a sorted array of signatures for each name = text column."""
    d = d.withColumns({f"_t_{n}": F.array_remove(F.split(F.lower(F.col(c)), r"[^\p{L}]+"), "") for n, c in texts.items()})

    def content(n: str) -> Column:
        t = F.col(f"_t_{n}")
        return F.when(F.size(t) > 0, F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: ~F.get(t, i).isin(ANCHORS))).otherwise(F.array().cast("array<int>"))

    d = d.withColumns({f"_p_{n}": content(n) for n in texts})

    def chains(n: str) -> Column:
        t, p = F.col(f"_t_{n}"), F.col(f"_p_{n}")
        before = lambda k: F.coalesce(F.get(p, k - 1), F.lit(-1))  # noqa: E731  the content word before the k-th
        tail = lambda k: F.concat_ws(" ", *[F.get(t, F.get(p, k + j)) for j in range(CHAIN)])
        at = F.filter(F.sequence(F.lit(0), F.size(p) - CHAIN), lambda k: F.get(p, k) - before(k) > 1)
        all_of = lambda k: F.transform(F.slice(t, before(k) + 2, F.get(p, k) - before(k) - 1), lambda a: _hash(F.concat_ws(" ", a, tail(k))))
        return F.when(F.size(p) >= CHAIN, F.array_sort(F.array_distinct(F.flatten(F.transform(at, all_of))))).otherwise(F.array().cast("array<string>"))

    d = d.withColumns({f"_s_{n}": chains(n) for n in texts})
    whole = lambda n: F.array(_hash(F.array_join(f"_t_{n}", " ")))
    d = d.withColumns({n: F.when(F.size(f"_s_{n}") > 0, F.col(f"_s_{n}")).otherwise(whole(n)) for n in texts})
    return d.drop(*[f"_{x}_{n}" for n in texts for x in "tps"])


def jaccard(a, b) -> Column:
    """Jaccard index of two arrays of distinct values, at least one of which is not empty."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def length_class(n: Column, percent: int = PERCENT) -> Column:
    """Sets that are like one another at the threshold are in the same class or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(-math.log(percent / 100)) + F.lit(1e-9)).cast("int")


def similar(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """Whether the Jaccard index is the threshold or more; sizes too far apart are not compared."""
    far = F.least(F.size(a), F.size(b)) * 100 < percent * F.greatest(F.size(a), F.size(b))
    return F.when(far, F.lit(False)).otherwise(100 * F.size(F.array_intersect(a, b)) >= percent * F.size(F.array_union(a, b)))


def _rank(x: Column, ends: list[int]) -> Column:
    """How many of the rising ends are x or less, by halving."""
    if not ends:
        return F.lit(0)
    listed = F.lit(ends).cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(ends).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(listed, at + step - 1) <= x, at + step).otherwise(at))


def _next_to(docs: DataFrame) -> tuple[DataFrame, object]:
    """docs (doc_id, text) with its range and the heads of following ranges as ghosts; the order of a range."""
    ranges = max(1, min(MAX_RANGES, -(-docs.select("doc_id").count() // RANGE_ROWS)))
    ends = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], max(10_000, 10 * ranges))).first()[0] if ranges > 1 else []
    d = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_rank(F.col("doc_id"), ends or [])))
    heads = d.select("_range", "doc_id").groupBy("_range").agg(F.min("doc_id").alias("_head"))  # MAX_RANGES + 1 rows at most
    whole = Window.partitionBy(F.lit(0)).orderBy("_range")
    last = F.max("_range").over(Window.partitionBy(F.lit(0)))
    heads = heads.select(F.col("_range").alias("_own"), "_head", F.coalesce(F.lag("_range").over(whole), last).alias("_to"))
    ghosts = d.join(F.broadcast(heads), (F.col("_range") == F.col("_own")) & F.col("doc_id").eqNullSafe(F.col("_head")))
    ghosts = ghosts.select("doc_id", "text", F.col("_to").alias("_range"), F.lit(True).alias("_ghost"))
    d = d.select("doc_id", "text", "_range", F.lit(False).alias("_ghost")).unionByName(ghosts)
    return d, Window.partitionBy("_range").orderBy("_ghost", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next."""
    d, order = _next_to(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")))
    d = d.withColumn("_next", F.coalesce(F.lead("text").over(order), F.lit(""))).withColumn("n_chars", F.length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    d = d.withColumn("_edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("_next", F.lit(1), half)))
    d = d.withColumn("edited_sha256", F.sha2("_edited", 256))
    d = _with_signatures(d, _own="text", _changed="_edited").drop("_next", "_edited")
    d = d.withColumn("_following", F.lead("_own").over(order)).filter("not _ghost")
    return d.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("_own", "").alias("fingerprint"), F.array_join("_changed", "").alias("edited_fingerprint"),
        jaccard(F.col("_own"), F.col("_changed")).alias("near_edited"), jaccard(F.col("_own"), F.col("_following")).alias("near_next"),
        length_class(F.size("_own")).alias("length_class"), similar(F.col("_own"), F.col("_following")).alias("same_as_next"),
    )


def op6_spotsigs(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


def oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in ANCHORS)
    tail = " || ' ' || ".join(f"t[p[k + {j}]]" for j in range(CHAIN))
    sigs = lambda t: rf"""(SELECT CASE WHEN len(s) > 0 THEN s ELSE [substr(md5(array_to_string(t, ' ')), 1, {HEX})] END FROM (
      SELECT t, list_sort(list_distinct(flatten(list_transform(range(1, len(p) - {CHAIN} + 2), lambda k: list_transform(t[(CASE WHEN k = 1 THEN 0 ELSE p[k - 1] END) + 1 : p[k] - 1], lambda a: substr(md5(a || ' ' || {tail}), 1, {HEX})))))) AS s FROM (
        SELECT t, list_filter(range(1, len(t) + 1), lambda i: t[i] NOT IN ({stops})) AS p FROM (
          SELECT list_filter(string_split_regex(lower({t}), '[^\p{{L}}]+'), lambda x: x <> '') AS t))))"""  # noqa: E731
    return rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS r, doc_id, coalesce(text, '') AS x FROM documents),
e AS (SELECT r, doc_id, x, length(x)::BIGINT AS n_chars, coalesce(lead(r) OVER (ORDER BY r), 1) AS nr, coalesce(lead(x) OVER (ORDER BY r), (SELECT x FROM d WHERE r = 1)) AS nx FROM d),
f AS (SELECT *, left(x, (n_chars - n_chars // 2)::INTEGER) || left(nx, (n_chars // 2)::INTEGER) AS edited FROM e),
g AS (SELECT *, {sigs('f.x')} AS own, {sigs('f.edited')} AS changed FROM f),
h AS (SELECT g.*, n.own AS following FROM g JOIN (SELECT r AS kr, own FROM g) n ON n.kr = g.nr)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(changed, '') AS edited_fingerprint,
       len(list_intersect(own, changed))::DOUBLE / (len(own) + len(changed) - len(list_intersect(own, changed))) AS near_edited,
       len(list_intersect(own, following))::DOUBLE / (len(own) + len(following) - len(list_intersect(own, following))) AS near_next,
       floor(ln(len(own)::DOUBLE) / {-math.log(PERCENT / 100)!r}::DOUBLE + 1e-9)::INTEGER AS length_class,
       100 * len(list_intersect(own, following)) >= {PERCENT} * (len(own) + len(following) - len(list_intersect(own, following))) AS same_as_next
FROM h
"""
