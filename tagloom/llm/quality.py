"""Quality rules: a threshold table compiled into one projection.

``RULES`` names a measure and the closed range in which a text is good. ``judge``
compiles the table into plain column expressions; no user function runs. Base
measures, over words ``[^\\x20\\x09-\\x0D]+`` of the whole text:

* ``word_chars``: code points in words; ``n_symbols``: characters of ``#*$%&|<>``;
* ``n_dup_lines``: lines (split at ``\\n``) that hold a word and equal an earlier line;
* ``n_repeat_words``: words inside a 3-word window that the text has twice or more,
  the first occurrence included; each word counts once.

Defined results: a null or empty text has no words and fails the base rule; repeated
rows are judged one by one; an empty table gives an empty table; other columns are
ignored by ``judge`` and no name of theirs can clash, since only ``id_col`` and
``text_col`` are read. A ratio whose denominator is 0 counts as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words_of

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Common words of the four languages that the corpus has, in lower case and capitalised.
STOP_WORDS = sorted(
    {
        w2
        for w in (
            "the of and to in a is that it for was on with as at by an be this from or are "
            "der die das und in den von zu mit ist im für auf des dem ein eine nicht sich auch "
            "le la les de des et en un une que qui dans pour est du au sur pas il elle par "
            "el los las y de que en un una con por para es se no su al lo como del"
        ).split()
        for w2 in (w, w.capitalize())
    }
)

#: name, measure, lowest and highest good value (None: no bound).
RULES = [
    ("mean_word_chars", "word_chars / n_words", 2.0, 14.0),
    ("symbol_ratio", "n_symbols / n_words", None, 0.25),
    ("stop_word_ratio", "n_stop_words / n_words", 0.02, None),
    ("dup_line_ratio", "n_dup_lines / n_lines", None, 0.50),
    ("bullet_line_ratio", "n_bullet_lines / n_lines", None, 0.90),
    ("ellipsis_line_ratio", "n_ellipsis_lines / n_lines", None, 0.30),
    ("exclaimed_word_ratio", "n_exclaimed_words / n_words", None, 0.50),
]


def _repeat_words(words):
    """Words covered by 3-word windows found twice or more.

    Windows are compared by a 64-bit hash. Sorted by (hash, place), a window is repeated
    if a neighbour has its hash; the union of the repeated windows is the sum, over their
    sorted places, of the gap to the next place, 3 at most."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    bind = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  evaluates value once

    def covered(h):
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        places = F.sort_array(F.transform(bind(ordered, repeated), lambda x: x["i"]))
        gaps = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, g: a + g)
        return bind(places, gaps)

    n = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(n).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the measures that the rules use, one row for each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col), text.alias("_t"), words_of(F.col(text_col)).alias("_w"), F.split(text, "\n").alias("_split"))
    d = d.select(id_col, "_t", "_w", F.filter("_split", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    count = lambda c: F.size(c).cast("long")
    return d.select(
        id_col,
        count("_w").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        count("_l").alias("n_lines"),
        count(F.filter("_w", lambda w: w.isin(STOP_WORDS))).alias("n_stop_words"),
        count(F.filter("_w", lambda w: w.endswith("!!"))).alias("n_exclaimed_words"),
        count(F.filter("_l", lambda x: x.rlike(r"^[ \t]*[-*•]"))).alias("n_bullet_lines"),
        count(F.filter("_l", lambda x: x.endswith("...") | x.endswith("…"))).alias("n_ellipsis_lines"),
    )


def verdict(rules=None):
    """The threshold table as one expression: the names of the rules that a row breaks."""
    broken = []
    for name, measure, low, high in RULES if rules is None else rules:
        part, whole = (F.col(x.strip()) for x in measure.split("/"))
        value = F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)
        bad = F.lit(False)
        if low is not None:
            bad = bad | (value < F.lit(float(low)))
        if high is not None:
            bad = bad | (value > F.lit(float(high)))
        broken.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge(docs: DataFrame, rules=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the base measures, base_failed, kept and broken_rules, one row for each row of docs."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    m = measures(docs, id_col, text_col).withColumns({"base_failed": failed, "_broken": verdict(rules)})
    return m.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("_broken") == 0)).alias("kept"), F.array_join("_broken", ",").alias("broken_rules"))


def op3_quality_rules(spark, sf_dir):
    from .common import table

    return judge(table(spark, sf_dir, "documents"))


def oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    cases = []
    for name, measure, low, high in RULES:
        part, whole = (x.strip() for x in measure.split("/"))
        value = f"(CASE WHEN {whole} = 0 THEN 0.0::DOUBLE ELSE {part}::DOUBLE / {whole} END)"
        bad = " OR ".join(x for x in (f"{value} < {low}::DOUBLE" if low is not None else "", f"{value} > {high}::DOUBLE" if high is not None else "") if x)
        cases.append(f"CASE WHEN {bad} THEN '{name}' END")
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n >= 2),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: x IN ({stops})))::BIGINT AS n_stop_words,
         len(list_filter(w, lambda x: ends_with(x, '!!')))::BIGINT AS n_exclaimed_words,
         len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*\x{{2022}}]')))::BIGINT AS n_bullet_lines,
         len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, chr(8230))))::BIGINT AS n_ellipsis_lines
  FROM d LEFT JOIN cov ON d.rid = cov.rid),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
        array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), ',') AS broken_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken_rules = '' AS kept, broken_rules FROM v
"""
