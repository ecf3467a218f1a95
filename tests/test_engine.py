"""The barcode engine's operators on small tables with known results."""

import math
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.config import Barcode, ConfigError, Regexes, auto_threshold, check_names, check_regexes, regexes_are_valid
from tagloom.functions.sequences import hamming, segments, strict_hamming
from tagloom.operators import combos, demultiplex as dm, hopping, similarity, statistics


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def table(spark, columns, data):
    return spark.createDataFrame(data, columns)


def test_hamming_cuts_the_longer(spark):
    d = spark.createDataFrame([("ACGT", "ACGA"), ("ACGT", "AC"), ("", "A"), (None, "A"), ("AAAA", "TTTTT")], "a string, b string")
    assert [r[0] for r in d.select(hamming(F.col("a"), F.col("b"))).collect()] == [1, 0, 0, None, 4]
    assert [r[0] for r in d.select(strict_hamming(F.col("a"), F.col("b"))).collect()] == [1, None, None, None, None]


def test_segments_cover_a_tag(spark):
    d = spark.createDataFrame([("ABCDEFG",), ("A",)], "t string")
    assert [r[0] for r in d.select(segments(F.col("t"), 1)).collect()] == [["ABC", "DEFG"], ["A", ""]]


def test_auto_threshold():
    assert auto_threshold(["ACGTA"]) == math.inf
    assert auto_threshold(["AAAAA", "TTTTT", "AATTT"]) == 0
    assert auto_threshold(["AAAAA", "TTTTT"]) == 2


def test_configuration_checks():
    with pytest.raises(ConfigError):
        check_names(["lid1", "sample"])
    h = [Barcode("lid"), Barcode("sample")]
    check_regexes(h, Regexes({"*": {"query": "(?P<lid1>A)(?P<lid2>C)(?P<sample>G)"}}), ["g"])
    with pytest.raises(ConfigError):
        check_regexes(h, Regexes({"*": {"query": "(?P<lid>A)"}}), ["g"])
    with pytest.raises(ConfigError):
        check_regexes(h, Regexes({"*": {"query": "(?P<lid>A)(?P<sample>A)(?P<umi>A)"}}), ["g"])
    assert Regexes({"*": {"a": "1", "b": "2"}, "g": {"a": "3"}}).of("g") == {"a": "3", "b": "2"}
    assert regexes_are_valid(["(?P<sample>A)(?P<lid0>C)"]) and not regexes_are_valid(["(?P<sample>A)"])


def test_extract_joins_numbered_groups(spark):
    d = spark.createDataFrame([("AACC", "GGTT"), ("xx", None)], "BC string, query string")
    out = dm.extract(d, {"BC": "(?P<lid1>AA)(?P<sample>C)", "query": "(?P<lid2>GG)(?P<umi>T)?"}, ["lid", "sample", "umi"])
    assert rows(out, "lid", "sample", "umi") == [("", "", ""), ("AAGG", "C", "T")]


def test_extract_fuzzy(spark):
    d = spark.createDataFrame([("TTACGAAA",), ("TTTTTTTT",)], "query string")
    out = dm.extract(d, {"query": "(?P<lid>[ACGT]{2}(?P<lib>ACGT){s<=1}[ACGT]+)"}, ["lid", "lib"])
    assert rows(out, "lid", "lib")[1] == ("TTACGAAA", "ACGA")


def test_reference_name_takes_the_first_near_one(spark):
    refs = (("ACGT", "one"), ("ACGA", "two"))
    d = spark.createDataFrame([("ACGA",), ("ACGC",), ("TTTT",), ("AC",)], "b string")
    assert [r[0] for r in d.select(dm.reference_name(F.col("b"), refs, 1)).collect()] == ["two", "one", None, "one"]
    assert [r[0] for r in d.select(dm.reference_name(F.col("b"), refs[:1], math.inf)).collect()] == ["one"] * 4


def test_demultiplex_counts_and_reasons(spark):
    h = [Barcode("sample", "reference", (("ACGTA", "s0"), ("TTTTT", "s1")), 1), Barcode("lid", min_length=3, max_length=4)]
    reads = spark.createDataFrame([("ACGTAGGGGG",), ("ACGTCGGGGG",), ("TTTTTCC",), ("GGGGGCCCC",), ("TTTTTCCC",), ("",)], "query string")
    out, stats = dm.demultiplex(reads, h, {"query": "(?P<sample>[ACGT]{5})(?P<lid>[ACGT]+)"})
    assert rows(out, "sample", "lid", "reads") == [("s0", "GGGG", 2), ("s1", "CCC", 1)]
    s = {(r["kind"], r["value"]): r["reads"] for r in stats.collect()}
    assert s == {("processed", None): 6, ("remaining", None): 3, ("failed", "sample"): 1, ("failed", "lid"): 1, ("failed", "lid_length"): 1, ("failed", "sample_correction_failed"): 1, ("success", "s0"): 2, ("success", "s1"): 1}


def corrected(spark, tags):
    d = table(spark, ["tags", "reads"], tags)
    return rows(similarity.correct_level(d, [], "tags"), "tags", "reads")


@pytest.mark.parametrize(
    ("tags", "result"),
    [
        ([("AAAA", 1), ("AAAT", 10), ("AATA", 10), ("ATAA", 10)], [("AAAT", 10), ("AATA", 10), ("ATAA", 10)]),
        ([("AAAA", 32), ("AAAT", 8), ("ACGT", 4), ("AATT", 2), ("AACC", 16), ("AACT", 1)], [("AAAA", 42), ("AACC", 16), ("ACGT", 4)]),
        ([("AAAA", 10), ("AAAC", 5), ("AAAG", 1)], [("AAAA", 16)]),
        ([("CAAAA", 1), ("AAAAA", 10)], [("AAAAA", 11)]),
        ([("AAAA", 3), ("AAA", 1)], [("AAA", 1), ("AAAA", 3)]),
    ],
)
def test_roots(spark, tags, result):
    assert corrected(spark, tags) == result


def test_correction_stays_in_its_prefix(spark):
    d = table(spark, ["sample", "tags", "reads"], [("a", "AAAA", 5), ("a", "AAAT", 1), ("b", "AAAT", 2)])
    out = similarity.error_correct(d, [Barcode("sample", "reference"), Barcode("tags")])
    assert rows(out, "sample", "tags", "reads") == [("a", "AAAA", 6), ("b", "AAAT", 2)]


def test_banded_links(spark):
    d = table(spark, ["tags", "start", "reads"], [("AAAA", 10, 5), ("AAAT", 12, 1), ("AAAC", 99, 1)])
    assert rows(similarity.links(d, [], "tags", 1, {"start": 2}), "child", "parent") == [("AAAT", "AAAA")]


@settings(max_examples=5, deadline=None)
@given(st.dictionaries(st.text("ACG", min_size=3, max_size=3), st.integers(1, 9), min_size=1, max_size=9))
def test_unique_roots_and_reads_are_kept(spark, tags):
    out = dict(corrected(spark, list(tags.items())))
    near = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    parents = {t: [p for p in tags if near(t, p) and (tags[p], p) > (tags[t], t)] for t in tags}

    def ends(t):
        return {t} if not parents[t] else set().union(*[ends(p) for p in parents[t]])

    want = {}
    for t, n in tags.items():
        found = ends(t)
        if len(found) == 1:
            root = found.pop()
            want[root] = want.get(root, 0) + n
    assert out == want


def test_binomial_quantile():
    def exact(alpha, n, k):
        p, tail, j = Fraction(1, k), Fraction(0), n
        while j > 0:
            tail += comb(n, j) * p**j * (1 - p) ** (n - j)
            if tail > alpha:
                return j
            j -= 1
        return 0

    for n in range(1, 40):
        for k in (2, 3, 5, 17):
            for alpha in (0.01, 0.05, 0.2):
                assert hopping.binomial_isf(alpha, n, 1 / k) == exact(alpha, n, k)
    assert 500_000 < hopping.binomial_isf(0.05, 1_000_000, 0.5) < 501_000
    assert hopping.binomial_isf(0.05, 7, 1.0) == 7


def test_hopping(spark):
    d = table(spark, ["sample", "lid", "reads"], [("a", "x", 100), ("b", "x", 2), ("c", "x", 90), ("a", "y", 3), ("a", "z", 1), ("b", "z", 1)])
    t = {(r["sample"], r["lid"]): r["hopping_threshold"] for r in hopping.thresholds(d, ["sample"]).collect()}
    assert t[("a", "y")] == 3 and t[("a", "z")] == 1 and t[("a", "x")] == hopping.binomial_isf(0.05, 192, 1 / 3)
    assert rows(hopping.hopping_removal(d, ["sample"]), "sample", "lid") == [("a", "x"), ("a", "y"), ("a", "z"), ("b", "z"), ("c", "x")]
    assert hopping.hopping_removal(d, [["sample", "lid"]]).count() == 2  # no anchors: one group


def test_combos(spark):
    a = table(spark, ["lid", "sample", "reads"], [("x", "s", 1), ("y", "s", 2)])
    b = table(spark, ["lid", "sample", "reads"], [("x", "s", 4), ("z", "s", 8)])
    assert rows(combos.combine([a, b]), "lid", "reads") == [("x", 5), ("y", 2), ("z", 8)]
    n = table(spark, ["lid", "reads"], [("ACG", 3), ("NNN", 2)])
    assert rows(combos.remove_ambiguous(n, [Barcode("lid")]), "lid", "reads") == [("ACG", 3)]
    assert combos.totals(n).first().asDict() == {"combinations": 2, "reads": 5}
    assert combos.totals(n.limit(0)).first().asDict() == {"combinations": 0, "reads": 0}
    limits = table(spark, ["lid", "threshold"], [("x", 5)])
    assert rows(combos.threshold(combos.combine([a, b]), limits), "lid") == [("x",)]
    assert rows(combos.threshold(a, table(spark, ["threshold"], [(2,)])), "lid") == [("y",)]


def test_overlap_and_jaccard(spark):
    d = table(spark, ["lid", "sample", "reads"], [("x", "a", 10), ("x", "b", 5), ("x", "c", 1), ("y", "a", 2)])
    got = {(r["lid"], r["sample"]): r["overlap"] for r in combos.overlap(d, "sample", ["lid"], {"a": "g", "c": "g"}).collect()}
    assert got == {("x", "a"): 1.0, ("x", "b"): 0.5, ("x", "c"): 1.1, ("y", "a"): 1.0}
    assert combos.overlap_removal(combos.overlap(d, "sample", ["lid"]), 1.0).count() == 2
    assert rows(combos.jaccard(d, "sample"), "a", "b", "jaccard")[0] == ("a", "b", 0.5)


def test_statistics(spark):
    data = [("A", "control", 4), ("A", "control", 8), ("A", "control", 16), ("B", "x", 10), ("C", "x", 1), ("C", "x", 1)]
    d = table(spark, ["grna", "category", "reads"], data)
    got = {r["grna"]: r for r in statistics.pvalues(d, "reads", ["grna"], draws=20_000, seed=1).collect()}
    assert got["C"]["pvalue"] == 0.0 and got["C"]["lineages"] == 2 and got["B"]["lineages"] == 1
    assert abs(got["B"]["pvalue"] - 2 / 3) < 0.02
    assert got["A"]["foldchange"] == pytest.approx(0)
    cats = table(spark, ["grna", "category"], [("A", "x"), ("A", "y")])
    with pytest.raises(statistics.NotUniqueError):
        statistics.with_category(d.drop("category"), cats)
    with pytest.raises(ValueError, match="control"):
        statistics.pvalues(d.filter("category = 'x'"), "reads", ["grna"])
    assert statistics.bootstrap_share(np.array([1.0, 2.0]), np.array([0.5, 3.0]), 3, 1000, 0).tolist() == [0.0, 1.0]


def test_controls_by_histogram_are_the_same_draws():
    v = np.array([0.0, 0.0, 1.0, 2.0, 2.0, 2.0])
    x = np.array([0.3, 0.9, 1.5])
    one = statistics.bootstrap_share(v, x, 3, 5000, 4)
    assert (one == statistics.bootstrap_share(np.array([0.0, 1.0, 2.0]), x, 3, 5000, 4, np.array([2, 1, 3]))).all()


PATTERNS = [
    "(?P<lid>[ACGT]{3})(?P<sample>A+)",
    "(?P<lid_1>[ACGT]{2,3}?)(?P<sample_bc>[^A])",
    "(?P<lid>A|CG)(?P<sample>(?P=lid))T",
    "(?P<lid>ACG){e}(?P<sample>.)",
    "(?P<lid>ACG){s<=1}(?P<sample>[ACGT])$",
    "(?P<lid>ACG){1<=e<=2}(?P<sample>T)",
    "^(?P<lid>.{,2})(?P<sample>.)",
    "(?i)(?P<lid>acg)(?P<sample>t)",
    "(?P<lid>\\w\\w)(?P<sample>\\.?)",
    "(?P<lid>[A-C&&B]+)(?P<sample>G)",
    "(?:(?P<lid>A)|(?P<sample>C))*+G",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_mean_what_they_mean_in_python(spark, pattern):
    import regex

    texts = ["ACGT", "ACGA", "AACGACGT", "CGCGT", "AAT", "", "ACCT", "GGAGTA", "acgt", "A.C", "ACG\n"]
    groups = list(regex.compile(pattern).groupindex)
    names = sorted({g.rstrip("0123456789") for g in groups})
    out = dm.extract(spark.createDataFrame([(t,) for t in texts], "query string"), {"query": pattern}, names).select("query", *names)
    got = {r[0]: tuple(r[1:]) for r in out.collect()}
    for t in texts:
        m = regex.search(pattern, t)
        parts = {g: (m[g] or "") if m else "" for g in groups}
        assert got[t] == tuple("".join(parts[g] for g in sorted(groups, key=lambda g: g if g[-1].isdigit() else g + "0") if g.rstrip("0123456789") == n) for n in names), t


def test_null_barcodes_are_kept_and_limits_are_checked(spark):
    d = spark.createDataFrame([("a", None, 500), ("b", None, 3), ("a", "x", 4)], "sample string, lid string, reads long")
    assert hopping.thresholds(d, ["sample"]).count() == 3
    assert sorted(r["reads"] for r in hopping.hopping_removal(d, [["sample"]]).collect()) == [4, 500]
    for columns in (["umi", "threshold"], ["lid"]):
        with pytest.raises(ConfigError):
            combos.threshold(d, table(spark, columns, [("x", 1)[: len(columns)]]))


@pytest.mark.parametrize("k", [1, 2])
def test_links_against_all_pairs(spark, k):
    r = np.random.default_rng(k)
    tags = {"".join(r.choice(list("AC"), n)): int(r.integers(1, 4)) for n in (1, 2, 5, 5, 5, 5, 6, 6, 6, 17, 17, 20) for _ in range(4)}
    got = set(rows(similarity.links(table(spark, ["tag", "reads"], list(tags.items())), [], "tag", k), "child", "parent"))
    far = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else 99
    assert got == {(a, b) for a in tags for b in tags if a != b and far(a, b) <= k and (tags[b], b) > (tags[a], a)}
