"""Chat formatting: collapse of cumulative snapshots, then rendering.

A log that stores a conversation after each exchange holds it many times, each shorter
one a turn-prefix of a longer one. Every turn gets two 64-bit hashes of its place, role
and text; their running sums are the rolling hashes of each turn-prefix (128 bits, and
exact sums, so equal prefixes have equal sums). A conversation goes if a longer one has
a prefix with its length and hashes (an anti-join), and of equal conversations the one
with the smallest id stays. What stays is rendered.

Exact copies and prefixes are collapsed to one row for each hash before they are joined,
so a first turn that a third of all conversations share is one row on either side.

Defined results: turns are in order of (turn, role, text), nulls first; rows repeated in
a conversation count once; a null role is rendered as ``unknown`` and a null text as
empty, though null and empty differ as turns; rows with a null conv_id are no
conversation; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text, n_turns and the rolling hashes h1, h2 after each turn."""
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    by = Window.partitionBy("conv_id").orderBy(*order)
    t = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    same = [F.lag(c).over(by).eqNullSafe(F.col(c)) for c in ("turn", "role", "text")]
    t = t.withColumn("_again", (F.row_number().over(by) > 1) & same[0] & same[1] & same[2]).filter(~F.col("_again"))
    t = t.withColumn("pos", F.row_number().over(by))
    what = [F.col("pos"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    to_now = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.select(
        "conv_id", "pos", "role", "text",
        F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n_turns"),
        *[F.sum(F.xxhash64(F.lit(k), *what).cast("decimal(20,0)")).over(to_now).alias(f"h{k}") for k in (1, 2)],
    )


def collapse(t: DataFrame) -> DataFrame:
    """conv_id of the maximal conversations of ``turns()``, and how many equal ones there were."""
    at = ["pos", "h1", "h2"]
    whole = t.filter(F.col("pos") == F.col("n_turns")).groupBy(*at).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    prefixes = t.filter(F.col("pos") < F.col("n_turns")).select(*at).distinct()
    return whole.join(prefixes, at, "left_anti").select("conv_id", "n_equal")


def render(t: DataFrame, kept: DataFrame) -> DataFrame:
    """One text for each kept conversation of ``turns()``."""
    one = F.struct("pos", F.concat(F.lit(START), F.coalesce("role", F.lit("unknown")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit("\n" + END)).alias("said"))
    return t.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_equal").agg(F.array_join(F.sort_array(F.collect_list(one))["said"], "").alias("rendered"))


def format_chats(conversations: DataFrame) -> DataFrame:
    t = turns(conversations)
    return render(t, collapse(t)).select("conv_id", "n_turns", "n_equal", "rendered")


def op4_chat_formatting(spark, sf_dir):
    return format_chats(table(spark, sf_dir, "conversations"))


def oracle() -> str:
    return rf"""
WITH u AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM u),
p AS (SELECT conv_id, pos, n_turns,
        string_agg(CASE WHEN role IS NULL THEN '-' ELSE length(role) || '+' || role END || ':' || CASE WHEN text IS NULL THEN '-' ELSE length(text) || '+' || text END, ';')
          OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM t),
whole AS (SELECT prefix, pos, min(conv_id) AS conv_id, count(*) AS n_equal FROM p WHERE pos = n_turns GROUP BY prefix, pos),
kept AS (SELECT conv_id, n_equal FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n_turns AND p.pos = w.pos AND p.prefix = w.prefix))
SELECT conv_id, n_turns::BIGINT AS n_turns, n_equal::BIGINT AS n_equal,
       string_agg('{START}' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM t JOIN kept USING (conv_id) GROUP BY conv_id, n_turns, n_equal
"""
