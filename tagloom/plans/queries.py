"""The engine's operators on the driver's tables, each with its SQL.

Reads are derived from lineitem: the sample is the return flag, the guide RNA the supplier
modulo 5, the lineage an 8-letter hash of the order, with errors by line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.config import Barcode, auto_threshold
from tagloom.functions.scratch import written
from tagloom.operators import combos, demultiplex as dm, hopping, similarity, statistics

LETTERS = "ACGTACGTACGTACGT"
SAMPLES = (("ACGTA", "A"), ("GGTCA", "N"), ("TTACG", "R"))
PLAIN = r"^(?P<lib>GGGC)(?P<sample>[ACGT]{5})(?P<lid1>[ACGT]{4})(?P<lid2>[ACGT]+)"
FUZZY = r"^(?P<lib>(?:GGGC){s<=1})(?P<sample>[ACGT]{5})(?P<lid>[ACGT]+)"


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, grna, lid and the read, one row for each sequenced molecule."""
    d = lineitem(spark, sf_dir)
    lid0 = F.translate(F.substring(F.md5((F.col("l_orderkey") % 300).cast("string").cast("binary")), 1, 8), "0123456789abcdef", LETTERS)
    d = d.select("l_linenumber", F.col("l_returnflag").alias("sample"), F.concat(F.lit("g"), (F.col("l_suppkey") % 5).cast("string")).alias("grna"), lid0.alias("_l"))
    lid = F.when(F.col("l_linenumber") == 3, F.concat(F.substring("_l", 1, 1), F.lit("A"), F.substring("_l", 3, 8)))
    lid = lid.when(F.col("l_linenumber") == 4, F.concat(F.substring("_l", 1, 2), F.lit("T"), F.substring("_l", 4, 8))).otherwise(F.col("_l"))
    code = F.when(F.col("sample") == "A", "ACGTA").when(F.col("sample") == "N", "GGTCA").otherwise("TTACG")
    code = F.when(F.col("l_linenumber") == 5, F.concat(F.lit("C"), F.substring(code, 2, 4))).when(F.col("l_linenumber") == 7, F.lit("CCCCC")).otherwise(code)
    lib = F.when(F.col("l_linenumber") == 2, "GGTC").when(F.col("l_linenumber") == 6, "ATGC").otherwise("GGGC")
    return d.select("sample", "grna", lid.alias("lid"), F.concat(lib, code, lid).alias("query"), "l_linenumber")


READS = f"""
r0 AS (SELECT l_linenumber, l_returnflag AS sample, 'g' || (l_suppkey % 5)::VARCHAR AS grna, translate(substr(md5((l_orderkey % 300)::VARCHAR), 1, 8), '0123456789abcdef', '{LETTERS}') AS l0 FROM lineitem),
r1 AS (SELECT *, CASE l_linenumber WHEN 3 THEN substr(l0, 1, 1) || 'A' || substr(l0, 3) WHEN 4 THEN substr(l0, 1, 2) || 'T' || substr(l0, 4) ELSE l0 END AS lid,
         CASE sample WHEN 'A' THEN 'ACGTA' WHEN 'N' THEN 'GGTCA' ELSE 'TTACG' END AS c0 FROM r0),
r AS (SELECT sample, grna, lid, l_linenumber, CASE l_linenumber WHEN 2 THEN 'GGTC' WHEN 6 THEN 'ATGC' ELSE 'GGGC' END
         || CASE l_linenumber WHEN 5 THEN 'C' || substr(c0, 2) WHEN 7 THEN 'CCCCC' ELSE c0 END || lid AS query FROM r1),
counts AS (SELECT sample, grna, lid, count(*)::BIGINT AS reads FROM r GROUP BY ALL)"""


def counts(spark, sf_dir) -> DataFrame:
    return reads(spark, sf_dir).groupBy("sample", "grna", "lid").agg(F.count(F.lit(1)).alias("reads"))


def _extract(spark, sf_dir, pattern):
    return dm.extract(reads(spark, sf_dir).select("query"), {"query": pattern}, ["lib", "sample", "lid"])


def _counted(d):
    return d.groupBy("lib", "sample", "lid").agg(F.count(F.lit(1)).alias("reads"))


def extract_plain(spark, sf_dir):
    return _counted(_extract(spark, sf_dir, PLAIN))


def extract_fuzzy_fixed(spark, sf_dir):
    return _counted(_extract(spark, sf_dir, FUZZY))


def filter_missing(spark, sf_dir):
    d = _extract(spark, sf_dir, PLAIN)
    return _counted(d.filter(F.size(dm.missing([Barcode("lib"), Barcode("sample"), Barcode("lid")])) == 0))


_lengths = [Barcode("sample"), Barcode("lid", min_length=9)]


def _trimmed(spark, sf_dir):
    d = reads(spark, sf_dir)
    return d.withColumn("lid", F.when(F.col("l_linenumber") % 2 == 0, F.concat("lid", F.lit("AC"))).otherwise(F.col("lid"))).select("sample", "lid")


def filter_min_length(spark, sf_dir):
    return _trimmed(spark, sf_dir).filter(F.size(dm.too_short(_lengths)) == 0).groupBy("sample", "lid").agg(F.count(F.lit(1)).alias("reads"))


def truncate_max(spark, sf_dir):
    return dm.truncate(_trimmed(spark, sf_dir), [Barcode("lid", max_length=5)]).groupBy("sample", "lid").agg(F.count(F.lit(1)).alias("reads"))


_demultiplexed = [Barcode("lib"), Barcode("sample", "reference", SAMPLES, 1), Barcode("lid", min_length=8, max_length=6)]


def demultiplexed(spark, sf_dir):
    return dm.demultiplex(reads(spark, sf_dir).select("query"), _demultiplexed, {"query": PLAIN})[0]


def fail_counters(spark, sf_dir):
    return dm.demultiplex(reads(spark, sf_dir).select("query"), _demultiplexed, {"query": PLAIN})[1]


def reference_correct(spark, sf_dir):
    seen = reads(spark, sf_dir).select(F.substring("query", 5, 5).alias("sample")).groupBy("sample").agg(F.count(F.lit(1)).alias("reads"))
    return seen.withColumn("name", dm.reference_name(F.col("sample"), SAMPLES, 1))


def auto_thresholds(spark, sf_dir):
    """The largest threshold that keeps the samples' sequences, and those of all lineages, apart."""
    lids = [r[0] for r in reads(spark, sf_dir).select("lid").distinct().collect()]  # a reference list: 900 at most, as they come from 300 hashes
    made = [("samples", float(auto_threshold(s for s, _ in SAMPLES))), ("lids", float(auto_threshold(lids)))]
    return spark.createDataFrame(made, "list string, threshold double")


def dedup_count(spark, sf_dir):
    return counts(spark, sf_dir)


def combine_partials(spark, sf_dir):
    d = reads(spark, sf_dir)
    part = lambda keep: d.filter(keep).groupBy("sample", "grna", "lid").agg(F.count(F.lit(1)).alias("reads"))
    return combos.combine([part(F.col("l_linenumber") <= 2), part(F.col("l_linenumber").between(3, 4)), part(F.col("l_linenumber") > 4)])


def dedup_single(spark, sf_dir):
    return combos.deduplicate(counts(spark, sf_dir).select("sample", "lid", "reads"))


def table_totals(spark, sf_dir):
    return combos.totals(counts(spark, sf_dir))


def remove_ambiguous(spark, sf_dir):
    d = counts(spark, sf_dir).withColumn("lid", F.when(F.col("grna") == "g1", F.regexp_replace("lid", "^A", "N")).otherwise(F.col("lid")))
    return combos.remove_ambiguous(d, [Barcode("sample", "reference"), Barcode("grna"), Barcode("lid")])


_prefix = ["sample", "grna"]


def similarity_edges(spark, sf_dir):
    return similarity.links(counts(spark, sf_dir), _prefix, "lid")


def root_assignment(spark, sf_dir):
    c = counts(spark, sf_dir)
    return similarity.roots(c, similarity.links(c, _prefix, "lid"), _prefix, "lid")


def error_correct_level(spark, sf_dir):
    return similarity.correct_level(counts(spark, sf_dir), _prefix, "lid")


def error_correct_hierarchy(spark, sf_dir):
    """The lineage below the sample, then the guide RNA (two letters, two errors apart at most one) below both."""
    c = counts(spark, sf_dir).select("sample", "lid", "grna", "reads")
    return similarity.error_correct(c, [Barcode("sample", "reference"), Barcode("lid"), Barcode("grna")])


def hopping_stats(spark, sf_dir):
    return hopping.group_counts(counts(spark, sf_dir), ["grna"])


def hopping_threshold(spark, sf_dir):
    return hopping.thresholds(counts(spark, sf_dir), ["grna"])


def hopping_removal(spark, sf_dir):
    return hopping.hopping_removal(counts(spark, sf_dir), [["grna"]])


def hopping_removal_multi(spark, sf_dir):
    return hopping.hopping_removal(counts(spark, sf_dir), [["grna"], ["sample"], ["sample", "grna"]])


_groups = {"A": "x", "N": "x"}


def overlap_ratio(spark, sf_dir):
    d = combos.deduplicate(counts(spark, sf_dir).select("sample", "lid", "reads"))
    return combos.overlap(d, "sample", ["lid"], _groups).withColumn("overlap", F.round("overlap", 9))


def overlap_removal(spark, sf_dir):
    d = combos.deduplicate(counts(spark, sf_dir).select("sample", "lid", "reads"))
    return combos.overlap_removal(combos.overlap(d, "sample", ["lid"]), 0.8).drop("overlap")


def jaccard(spark, sf_dir):
    return combos.jaccard(counts(spark, sf_dir), "grna").withColumn("jaccard", F.round("jaccard", 9))


def _limits(spark, keyed):
    rows = [("A", 2), ("N", 4)]
    return spark.createDataFrame(rows if keyed else [(3,)], "sample string, threshold int" if keyed else "threshold int")


def threshold_scalar(spark, sf_dir):
    return combos.threshold(counts(spark, sf_dir), _limits(spark, False))


def threshold_keyed(spark, sf_dir):
    return combos.threshold(counts(spark, sf_dir), _limits(spark, True))


def _categories(spark):
    return spark.createDataFrame([("g0", "control"), ("g1", "control"), ("g2", "neutral"), ("g3", "bigger"), ("g4", "smaller")], "grna string, category string")


def _categorised(spark, sf_dir):
    return statistics.with_category(counts(spark, sf_dir), _categories(spark))


def category_join(spark, sf_dir):
    return _categorised(spark, sf_dir)


def teststatistic(spark, sf_dir):
    d = statistics.group_statistics(_categorised(spark, sf_dir), "reads", ["sample", "grna"])
    return d.select("sample", "grna", F.round("teststatistic", 9).alias("teststatistic"), "lineages")


def foldchange(spark, sf_dir):
    d = statistics.group_statistics(_categorised(spark, sf_dir), "reads", ["sample", "grna"])
    return d.select("sample", "grna", F.round("foldchange", 9).alias("foldchange"))


def pvalue_exact_n1(spark, sf_dir):
    return statistics.exact_single(_categorised(spark, sf_dir), "reads").withColumn("pvalue", F.round("pvalue", 9))


def pvalue_bootstrap(spark, sf_dir):
    d = statistics.pvalues(_categorised(spark, sf_dir), "reads", ["sample", "grna"], draws=20_000, seed=7)
    return statistics.category_results(d.filter("sample = 'A'").drop("sample"), _categories(spark))


def mate_zip(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_linenumber").cast("string").alias("group"), F.col("l_orderkey").alias("ordinal"), F.col("l_returnflag").alias("seq"), F.col("l_suppkey").alias("name"))
    return combos.zip_mates([("R1", d.select("group", "ordinal", "seq")), ("R2", d.filter("ordinal % 3 <> 0").select("group", "ordinal", "name"))])


def partition_bounds(spark, sf_dir):
    return combos.partition_bounds(counts(spark, sf_dir), ["sample", "grna"], ["lid"])


def unhandled_anti(spark, sf_dir):
    """Calls are lineages by sample; those with a combination of the last guide RNA have a result, but for lineages in T."""
    c = counts(spark, sf_dir)
    return combos.unhandled(c.select("sample", "lid").distinct(), c.filter("grna = 'g4' and substring(lid, 1, 1) <> 'T'").select("lid"), "lid")


def union_all_tables(spark, sf_dir):
    c = counts(spark, sf_dir)
    return c.filter("sample = 'A'").unionByName(c.filter("sample <> 'R'"))


def pipeline_full(spark, sf_dir):
    """Extract, correct samples, count, correct lineages, remove hopping, threshold."""
    hierarchy = [Barcode("sample", "reference", SAMPLES, 1), Barcode("lib"), Barcode("lid", min_length=8)]
    d = dm.demultiplex(reads(spark, sf_dir).select("query"), hierarchy, {"query": PLAIN.replace("GGGC", "[ACGT]{4}")})[0]
    d = written(similarity.correct_level(written(d, "demultiplex"), ["sample", "lib"], "lid"), "correct")  # as the stages write theirs
    d = hopping.hopping_removal(d, [["lib"]])
    return combos.threshold(d, _limits(spark, False))


def streaming_counts(spark, sf_dir):
    from tagloom.streaming import counts as stream

    return stream.run_once(spark, f"{sf_dir}/lineitem.parque[t]")


_ALL = [
    extract_plain, extract_fuzzy_fixed, filter_missing, filter_min_length, truncate_max, demultiplexed, fail_counters, reference_correct, auto_thresholds,
    dedup_count, combine_partials, dedup_single, table_totals, remove_ambiguous, similarity_edges, root_assignment, error_correct_level, error_correct_hierarchy,
    hopping_stats, hopping_threshold, hopping_removal, hopping_removal_multi, overlap_ratio, overlap_removal, jaccard, threshold_scalar, threshold_keyed,
    category_join, teststatistic, foldchange, pvalue_exact_n1, pvalue_bootstrap, mate_zip, partition_bounds, unhandled_anti, union_all_tables, pipeline_full, streaming_counts,
]


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def _plain(pattern: str) -> str:
    return f"""e AS (SELECT coalesce(nullif(regexp_extract(query, '{pattern}', 1), ''), '') AS lib, regexp_extract(query, '{pattern}', 2) AS sample, regexp_extract(query, '{pattern}', 3) || regexp_extract(query, '{pattern}', 4) AS lid FROM r)"""


_P = r"^(GGGC)([ACGT]{5})([ACGT]{4})([ACGT]+)"
_F = r"^([ACGTN]GGC|G[ACGTN]GC|GG[ACGTN]C|GGG[ACGTN])([ACGT]{5})([ACGT]+)()"
_TRIMMED = "t AS (SELECT sample, lid || CASE WHEN l_linenumber % 2 = 0 THEN 'AC' ELSE '' END AS lid FROM r)"
_REFERENCES = "ref AS (SELECT * FROM (VALUES ('ACGTA', 'A', 0), ('GGTCA', 'N', 1), ('TTACG', 'R', 2)) AS v(s, name, pos))"
_LOOKED = f"""{_REFERENCES},
look AS (SELECT x.sample, arg_min(ref.name, (CASE WHEN hamming(x.sample, ref.s) = 0 THEN 0 ELSE 1 END) * 10 + pos) AS name FROM (SELECT DISTINCT sample FROM e WHERE length(sample) = 5) x JOIN ref ON hamming(x.sample, ref.s) <= 1 GROUP BY 1)"""


def _edges(table: str, prefix: list[str], tag: str = "lid", name: str = "edges", n: str = "reads") -> str:
    on = "".join(f"c.{p} = p.{p} AND " for p in prefix)
    return f"""{name} AS (SELECT {''.join(f'c.{p}, ' for p in prefix)}c.{tag} AS child, p.{tag} AS parent FROM {table} c JOIN {table} p ON {on}length(c.{tag}) = length(p.{tag}) AND hamming(c.{tag}, p.{tag}) <= 1
  WHERE (p.{n} > c.{n} OR p.{n} = c.{n} AND p.{tag} > c.{tag}))"""


def _roots(table: str, prefix: list[str], tag: str = "lid", edges: str = "edges", name: str = "roots") -> str:
    p = "".join(f"{x}, " for x in prefix)
    return f"""walk_{name} AS (SELECT {p}{tag} AS tag, {tag} AS anc FROM {table} UNION SELECT {''.join(f'w.{x}, ' for x in prefix)}w.tag, e.parent FROM walk_{name} w JOIN {edges} e ON {''.join(f'w.{x} = e.{x} AND ' for x in prefix)}w.anc = e.child),
{name} AS (SELECT {''.join(f'w.{x}, ' for x in prefix)}w.tag AS {tag}, min(w.anc) AS first_root, max(w.anc) AS last_root FROM walk_{name} w WHERE NOT EXISTS (SELECT 1 FROM {edges} e WHERE {''.join(f'w.{x} = e.{x} AND ' for x in prefix)}w.anc = e.child) GROUP BY ALL)"""


def _isf(counts_table: str, name: str, alpha: float = 0.05) -> str:
    """Quantiles of the (n, k) of a table of groups."""
    return f"""{name}_j AS (SELECT n, k, unnest(generate_series(0, n)) AS j FROM (SELECT DISTINCT n, k FROM {counts_table} WHERE c > 1 AND k > 1)),
{name}_p AS (SELECT n, k, j, exp(lgamma(n + 1) - (CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END) - (CASE WHEN n = j THEN 0 ELSE lgamma(n - j + 1) END) + j * ln(1.0::DOUBLE / k) + (n - j) * ln(1 - 1.0::DOUBLE / k)) AS p FROM {name}_j),
{name}_t AS (SELECT n, k, j, coalesce(sum(p) OVER (PARTITION BY n, k ORDER BY j DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tail FROM {name}_p),
{name} AS (SELECT n, k, min(j)::BIGINT AS q FROM {name}_t WHERE tail <= {alpha} GROUP BY n, k)"""


def _groups_of(table: str, anchors: list[str], name: str) -> str:
    a = "".join(f"{x}, " for x in anchors)
    return f"{name} AS (SELECT {a}sum(reads)::BIGINT AS n, count(*)::BIGINT AS c, count(*) FILTER (reads > 1)::BIGINT AS k, max(reads)::BIGINT AS most FROM {table} GROUP BY ALL)"


def _limit(table: str, barcodes: list[str], anchors: list[str], name: str) -> str:
    on = " AND ".join(f"t.{x} = g.{x}" for x in anchors) or "TRUE"
    return f"""{_groups_of(table, anchors, name + '_g')}, {_isf(name + '_g', name + '_q')},
{name} AS (SELECT {', '.join('t.' + b for b in barcodes)}, t.reads, (CASE WHEN c = 1 THEN t.reads WHEN g.k > 1 THEN q ELSE most END)::BIGINT AS hopping_threshold FROM {table} t JOIN {name}_g g ON {on} LEFT JOIN {name}_q qq ON qq.n = g.n AND qq.k = g.k)"""


_CATEGORIES = "cat AS (SELECT * FROM (VALUES ('g0', 'control'), ('g1', 'control'), ('g2', 'neutral'), ('g3', 'bigger'), ('g4', 'smaller')) AS v(grna, category)), cc AS (SELECT counts.*, category FROM counts JOIN cat USING (grna))"


def oracle_sql() -> dict[str, str]:
    w, wr = f"WITH {READS}", f"WITH RECURSIVE {READS}"
    group = "SELECT lib, sample, lid, count(*)::BIGINT AS reads FROM e"
    b = ["sample", "grna", "lid"]
    slid = "s AS (SELECT sample, lid, sum(reads)::BIGINT AS reads FROM counts GROUP BY ALL)"
    stages = f"""{_plain(_P)}, {_LOOKED},
bad AS (SELECT *, lib = '' OR sample = '' OR lid = '' AS gone, lid <> '' AND length(lid) < 8 AS short FROM e),
ok AS (SELECT lib, name AS sample, substr(lid, 1, 6) AS lid, bad.sample AS raw FROM bad LEFT JOIN look ON bad.sample = look.sample WHERE NOT gone AND NOT short)"""
    over = lambda groups: f"""o AS (SELECT *, row_number() OVER ww AS k, first_value(reads) OVER ww AS top, first_value({groups}) OVER ww AS tg, {groups} AS g FROM s WINDOW ww AS (PARTITION BY lid ORDER BY reads DESC, sample ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
    ratio = "CASE WHEN k = 1 THEN 1.0::DOUBLE WHEN g = tg THEN 1.1::DOUBLE ELSE reads::DOUBLE / top END"
    full = _plain(r"^([ACGT]{4})([ACGT]{5})([ACGT]{4})([ACGT]+)")
    two = ["sample", "lib"]
    return {
        "extract_plain": f"{w}, {_plain(_P)} {group} GROUP BY ALL",
        "extract_fuzzy_fixed": f"{w}, {_plain(_F)} {group} GROUP BY ALL",
        "filter_missing": f"{w}, {_plain(_P)} {group} WHERE lib <> '' AND sample <> '' AND lid <> '' GROUP BY ALL",
        "filter_min_length": f"{w}, {_TRIMMED} SELECT sample, lid, count(*)::BIGINT AS reads FROM t WHERE length(lid) >= 9 GROUP BY ALL",
        "truncate_max": f"{w}, {_TRIMMED} SELECT sample, substr(lid, 1, 5) AS lid, count(*)::BIGINT AS reads FROM t GROUP BY ALL",
        "demultiplexed": f"{w}, {stages} SELECT lib, sample, lid, count(*)::BIGINT AS reads FROM ok WHERE sample IS NOT NULL GROUP BY ALL",
        "fail_counters": f"""{w}, {stages}
SELECT 'processed' AS kind, NULL::VARCHAR AS barcode, NULL::VARCHAR AS value, count(*)::BIGINT AS reads FROM e HAVING count(*) > 0
UNION ALL SELECT 'remaining', NULL, NULL, count(*)::BIGINT FROM ok WHERE sample IS NOT NULL HAVING count(*) > 0
UNION ALL SELECT 'failed', NULL, x, count(*)::BIGINT FROM (SELECT unnest([CASE WHEN lib = '' THEN 'lib' END, CASE WHEN sample = '' THEN 'sample' END, CASE WHEN lid = '' THEN 'lid' END, CASE WHEN NOT gone AND short THEN 'lid_length' END]) AS x FROM bad) WHERE x IS NOT NULL GROUP BY x
UNION ALL SELECT 'failed', NULL, 'sample_correction_failed', count(*)::BIGINT FROM ok WHERE sample IS NULL HAVING count(*) > 0
UNION ALL SELECT 'success', 'sample', sample, count(*)::BIGINT FROM ok WHERE sample IS NOT NULL GROUP BY sample""",
        "reference_correct": f"{w}, e AS (SELECT substr(query, 5, 5) AS sample FROM r), {_LOOKED} SELECT e.sample, count(*)::BIGINT AS reads, any_value(name) AS name FROM e LEFT JOIN look USING (sample) GROUP BY e.sample",
        "auto_thresholds": f"""{w}, {_REFERENCES}, every AS (SELECT DISTINCT lid FROM counts)
SELECT 'samples' AS list, min(trunc((hamming(a.s, b.s) - 1) / 2.0))::DOUBLE AS threshold FROM ref a JOIN ref b ON a.s < b.s
UNION ALL SELECT 'lids', min(trunc((hamming(a.lid, b.lid) - 1) / 2.0))::DOUBLE FROM every a JOIN every b ON a.lid < b.lid""",
        "dedup_count": f"{w} SELECT * FROM counts",
        "combine_partials": f"{w} SELECT * FROM counts",
        "dedup_single": f"{w} SELECT sample, lid, sum(reads)::BIGINT AS reads FROM counts GROUP BY ALL",
        "table_totals": f"{w} SELECT count(*)::BIGINT AS combinations, sum(reads)::BIGINT AS reads FROM counts",
        "remove_ambiguous": f"{w} SELECT sample, grna, lid, reads FROM counts WHERE NOT (grna = 'g1' AND starts_with(lid, 'A'))",
        "similarity_edges": f"{w}, {_edges('counts', _prefix)} SELECT * FROM edges",
        "root_assignment": f"{wr}, {_edges('counts', _prefix)}, {_roots('counts', _prefix)} SELECT * FROM roots",
        "error_correct_level": f"{wr}, {_edges('counts', _prefix)}, {_roots('counts', _prefix)} SELECT sample, grna, first_root AS lid, sum(reads)::BIGINT AS reads FROM counts JOIN roots USING (sample, grna, lid) WHERE first_root = last_root GROUP BY ALL",
        "error_correct_hierarchy": f"""{wr}, {slid}, {_edges('s', ['sample'])}, {_roots('s', ['sample'])},
one AS (SELECT sample, first_root AS lid, grna, sum(reads)::BIGINT AS reads FROM counts JOIN roots USING (sample, lid) WHERE first_root = last_root GROUP BY ALL),
{_edges('one', ['sample', 'lid'], 'grna', 'edges2')}, {_roots('one', ['sample', 'lid'], 'grna', 'edges2', 'roots2')}
SELECT sample, lid, first_root AS grna, sum(reads)::BIGINT AS reads FROM one JOIN roots2 USING (sample, lid, grna) WHERE first_root = last_root GROUP BY ALL""",
        "hopping_stats": f"{w}, {_groups_of('counts', ['sample', 'lid'], 'g')} SELECT * FROM g",
        "hopping_threshold": f"{w}, {_limit('counts', b, ['sample', 'lid'], 'x')} SELECT * FROM x",
        "hopping_removal": f"{w}, {_limit('counts', b, ['sample', 'lid'], 'x')} SELECT sample, grna, lid, reads FROM x WHERE reads >= hopping_threshold",
        "hopping_removal_multi": f"""{w}, {_limit('counts', b, ['sample', 'lid'], 'x')}, {_limit('counts', b, ['grna', 'lid'], 'y')}, {_limit('counts', b, ['lid'], 'z')}
SELECT sample, grna, lid, x.reads FROM x JOIN y USING (sample, grna, lid) JOIN z USING (sample, grna, lid) WHERE x.reads >= x.hopping_threshold AND x.reads >= y.hopping_threshold AND x.reads >= z.hopping_threshold""",
        "overlap_ratio": f"{w}, {slid}, {over(chr(39).join(['CASE WHEN sample IN (', 'A', ', ', 'N', ') THEN ', 'x', ' ELSE sample END']))} SELECT sample, lid, reads, round({ratio}, 9) AS overlap FROM o",
        "overlap_removal": f"{w}, {slid}, {over('sample')} SELECT sample, lid, reads FROM o WHERE {ratio} >= 0.8::DOUBLE",
        "jaccard": f"""{w}, d AS (SELECT DISTINCT lid, grna FROM counts), n AS (SELECT grna, count(*) AS n FROM d GROUP BY 1)
SELECT a, b, round(k::DOUBLE / (na.n + nb.n - k), 9) AS jaccard FROM (SELECT x.grna AS a, y.grna AS b, count(*) AS k FROM d x JOIN d y ON x.lid = y.lid AND x.grna <> y.grna GROUP BY ALL) JOIN n na ON na.grna = a JOIN n nb ON nb.grna = b""",
        "threshold_scalar": f"{w} SELECT * FROM counts WHERE reads >= 3",
        "threshold_keyed": f"{w} SELECT * FROM counts WHERE sample = 'A' AND reads >= 2 OR sample = 'N' AND reads >= 4",
        "category_join": f"{w}, {_CATEGORIES} SELECT * FROM cc",
        "teststatistic": f"{w}, {_CATEGORIES} SELECT sample, grna, round(avg(log2(reads)), 9) AS teststatistic, count(*)::BIGINT AS lineages FROM cc GROUP BY ALL",
        "foldchange": f"{w}, {_CATEGORIES} SELECT sample, grna, round(avg(log2(reads)) - (SELECT avg(log2(reads)) FROM cc WHERE category = 'control'), 9) AS foldchange FROM cc GROUP BY ALL",
        "pvalue_exact_n1": f"{w}, {_CATEGORIES}, v AS (SELECT round(log2(reads), 9) AS value, category = 'control' AS is_control FROM cc), u AS (SELECT DISTINCT value FROM v) SELECT value, round((SELECT count(*) FROM v WHERE is_control AND v.value < u.value)::DOUBLE / (SELECT count(*) FROM v WHERE is_control), 9) AS pvalue FROM u",
        "mate_zip": "SELECT a.l_linenumber::VARCHAR AS \"group\", a.l_orderkey AS ordinal, a.l_returnflag AS \"R1seq\", b.l_suppkey AS \"R2name\" FROM lineitem a JOIN lineitem b ON a.l_linenumber = b.l_linenumber AND a.l_orderkey = b.l_orderkey WHERE b.l_orderkey % 3 <> 0",
        "partition_bounds": f"{w}, p AS (SELECT sample, grna, row_number() OVER (ORDER BY sample, grna, lid) - 1 AS place FROM counts) SELECT sample, grna, count(*)::BIGINT AS length, min(place)::BIGINT AS start FROM p GROUP BY ALL",
        "unhandled_anti": f"{w} SELECT DISTINCT sample, lid FROM counts c WHERE NOT EXISTS (SELECT 1 FROM counts d WHERE d.lid = c.lid AND d.grna = 'g4' AND substr(d.lid, 1, 1) <> 'T')",
        "union_all_tables": f"{w} SELECT * FROM counts WHERE sample = 'A' UNION ALL SELECT * FROM counts WHERE sample <> 'R'",
        "pipeline_full": f"""{wr}, {full}, {_LOOKED},
dm AS (SELECT name AS sample, lib, lid, count(*)::BIGINT AS reads FROM e JOIN look USING (sample) WHERE length(lid) >= 8 AND lib <> '' GROUP BY ALL),
{_edges('dm', two)}, {_roots('dm', two)},
ec AS (SELECT sample, lib, first_root AS lid, sum(reads)::BIGINT AS reads FROM dm JOIN roots USING (sample, lib, lid) WHERE first_root = last_root GROUP BY ALL),
{_limit('ec', ['sample', 'lib', 'lid'], ['sample', 'lid'], 'x')}
SELECT sample, lib, lid, reads FROM x WHERE reads >= hopping_threshold AND reads >= 3""",
        "streaming_counts": "SELECT l_returnflag AS sample, l_linenumber AS lane, count(*)::BIGINT AS reads FROM lineitem GROUP BY ALL",
    }
