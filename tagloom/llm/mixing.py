"""Mixing sources to target weights by hierarchical budgeting.

Documents hang on a tree domain > language > source. A token budget goes from the root
down. At each node it is shared among the children by weight, no child above what its
subtree can give (its tokens times ``max_epochs``): a shortage is shared among siblings,
and only what a whole subtree lacks goes back to the level above. Shares are exact in
integers: with the children in order of capacity / weight, child k is exhausted if
``capacity_k * W_k <= weight_k * R_k``, with W_k and R_k the weight and the budget left
before it; the others get ``floor(weight * R / W)`` of what the exhausted ones left.

A leaf that gets T of its A tokens is read in epochs, each a seeded order of its
documents: all of each full epoch, then the token-prefix of the next, whose last
document counts with the tokens that still fit.

The window that orders a leaf is split by ranges of the order key into so many buckets
that one holds about ``bucket_docs`` documents, so a source with a third of all rows is
spread; bucket totals give each bucket its start. The tree tables have one row per
leaf. All is DataFrame operations.

Defined results: null or word-less text has 0 tokens and is never selected; null
language or source is the leaf named ``""``; repeated rows are documents of their own
(ties in the order are broken by text length, then count as one another); an empty table
or a budget of 0 gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, table, words_of

LEVELS = ("domain", "lang", "source")
#: Weights of the tree's edges, in order of preference; every other edge weighs 1.
WEIGHTS = {("domain", "web"): 5, ("domain", "books"): 3, ("domain", "code"): 2, ("lang", "en"): 4, ("lang", "de"): 2, ("lang", "fr"): 2, ("lang", "es"): 2}
SEED, MAX_EPOCHS, BUDGET_PERCENT, BUCKET_DOCS = 20240501, 4, 80, 5_000
_BIG = "decimal(38,0)"


def domain_of(source: Column) -> Column:
    """The domain of a source: its name's digits, modulo 3; web where there are none."""
    n = F.regexp_extract(source, r"(\d{1,9})$", 1)
    k = F.when(n == "", F.lit(0)).otherwise(n.cast("long") % 3)
    return F.when(k == 0, "web").when(k == 1, "books").otherwise("code")


def _weight(level: str, weights) -> Column:
    out = F.lit(1)
    for (at, value), w in weights.items():
        if at == level:
            out = F.when(F.col(level) == value, F.lit(int(w))).otherwise(out)
    return out.cast(_BIG)


def _share(nodes: DataFrame, parents: list[str], level: str, weights) -> DataFrame:
    """nodes: the children (parents..., level, capacity, budget of the parent); adds their budget."""
    own = Window.partitionBy(*[F.col(x) for x in parents]) if parents else Window.partitionBy(F.lit(0))
    inner = own.orderBy(F.col("_ratio"), F.col(level))
    n = nodes.withColumn("_w", _weight(level, weights)).withColumn("_ratio", F.col("capacity").cast("double") / F.col("_w").cast("double"))
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumns({
        "_rest_budget": F.col("_budget").cast(_BIG) - F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast(_BIG),
        "_wsum": F.sum("_w").over(own).cast(_BIG) - F.coalesce(F.sum("_w").over(before), F.lit(0)).cast(_BIG),
    })
    full = (F.col("capacity").cast("decimal(28,0)") * F.col("_wsum").cast("decimal(10,0)")) <= (F.col("_w").cast("decimal(10,0)") * F.col("_rest_budget").cast("decimal(28,0)"))
    n = n.withColumn("_full", full)
    n = n.withColumns({
        "_left": F.max(F.when(~F.col("_full"), F.col("_rest_budget"))).over(own),
        "_open": F.max(F.when(~F.col("_full"), F.col("_wsum"))).over(own),
    })
    part = F.expr("(cast(_w as decimal(10,0)) * cast(_left as decimal(28,0))) div cast(_open as decimal(10,0))")
    return n.withColumn("_budget", F.when(F.col("_full"), F.col("capacity")).otherwise(part).cast(_BIG)).drop("_w", "_ratio", "_rest_budget", "_wsum", "_full", "_left", "_open")


def leaves(docs: DataFrame) -> DataFrame:
    """tokens and documents of each leaf; docs has LEVELS and tokens."""
    return docs.filter("tokens > 0").groupBy(*LEVELS).agg(F.sum("tokens").alias("leaf_tokens"), F.count(F.lit(1)).alias("leaf_docs"))


def budgets(leaf: DataFrame, budget: Column, max_epochs: int = MAX_EPOCHS, weights=None) -> DataFrame:
    """Adds ``leaf_budget``: what each leaf gives. budget: a literal or a column of ``leaf``."""
    weights = WEIGHTS if weights is None else weights
    capacity = (F.col("leaf_tokens").cast(_BIG) * F.lit(max_epochs).cast("decimal(9,0)")).cast(_BIG)
    out = leaf.withColumn("_cap", capacity).withColumn("_total", F.sum("leaf_tokens").over(Window.partitionBy(F.lit(0))))
    out = out.withColumn("_budget", budget.cast(_BIG))
    for k in range(len(LEVELS)):
        parents, level = list(LEVELS[:k]), LEVELS[k]
        nodes = out.groupBy(*parents, level).agg(F.sum("_cap").cast(_BIG).alias("capacity"), F.first("_budget").alias("_budget"))
        got = _share(nodes, parents, level, weights).select(*parents, level, "_budget")
        out = out.drop("_budget").join(got, parents + [level])
    return out.withColumn("leaf_budget", F.least(F.col("_budget"), F.col("_cap")).cast("long")).drop("_cap", "_total", "_budget")


def mix(docs: DataFrame, weights=None, budget: int | None = None, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """docs: doc_id, LEVELS and tokens, and whatever columns should follow.

    Adds ``epoch`` and ``take_tokens`` (how many of its tokens are wanted, over 0), one
    row for each selected document and epoch. budget: tokens wanted; by default
    budget_percent of all tokens there are."""
    scratch = Scratch(docs.sparkSession, "mix")  # token counts and the tree are made once and read thrice
    d = scratch.write(docs.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in LEVELS}))
    leaf = scratch.write(leaves(d))
    whole = F.sum("leaf_tokens").over(Window.partitionBy(F.lit(0))).cast("decimal(28,0)")
    goal = F.lit(budget) if budget is not None else F.floor(whole * F.lit(budget_percent).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)"))
    leaf = budgets(leaf.withColumn("_goal", goal), F.col("_goal"), max_epochs, weights).drop("_goal")
    leaf = scratch.write(leaf)
    leaf = leaf.withColumns({
        "_epochs": F.expr("cast(leaf_budget div leaf_tokens as int)"),
        "_rest": F.col("leaf_budget") % F.col("leaf_tokens"),
        "_buckets": F.ceil(F.col("leaf_docs") / F.lit(bucket_docs)).cast("int"),
    }).drop("leaf_tokens", "leaf_docs", "leaf_budget")
    d = d.filter("tokens > 0").join(leaf, list(LEVELS))
    d = d.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_epochs"))))
    d = d.filter((F.col("epoch") < F.col("_epochs")) | (F.col("_rest") > 0))
    d = d.withColumn("_key", order_key(seed, F.col("epoch")))
    head = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    d = d.withColumn("_bucket", F.shiftright(head * F.col("_buckets"), 32))
    group = [*LEVELS, "epoch"]
    last = d.filter(F.col("epoch") == F.col("_epochs"))
    sums = last.groupBy(*group, "_bucket").agg(F.sum("tokens").alias("_sum"))
    sums = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*group, "_bucket").orderBy("_key", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    last = last.join(sums, [*group, "_bucket"]).withColumn("_before", F.col("_start") + F.coalesce(F.sum("tokens").over(inner), F.lit(0))).filter(F.col("_before") < F.col("_rest"))
    last = last.withColumn("take_tokens", F.least(F.col("tokens"), F.col("_rest") - F.col("_before")).cast("long")).drop("_start", "_before")
    full = d.filter(F.col("epoch") < F.col("_epochs")).withColumn("take_tokens", F.col("tokens"))
    return full.unionByName(last).drop("_epochs", "_rest", "_buckets", "_key", "_bucket")


def select_rows(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs (doc_id, lang, source, text and others) that the first epoch selects.

    A leaf's selection is all its documents up to a key, so rows are compared with their
    leaf's last key and no text is shuffled. Rows of the same doc_id and leaf stand or
    fall together."""
    settings = {"seed": SEED, **settings, "max_epochs": 1}
    key = order_key(settings["seed"], F.lit(0))
    ends = mix(with_tokens(docs).select("doc_id", *LEVELS, "tokens"), **settings).groupBy(*LEVELS).agg(F.max(key).alias("end"))
    *levels, end = fresh(docs.columns, *[f"_{c}" for c in LEVELS], "_end")
    ends = ends.select(*[F.col(c).alias(n) for c, n in zip(LEVELS, levels, strict=True)], F.col("end").alias(end))
    ends = Scratch(docs.sparkSession, "ends").write(ends)  # a row for each leaf: its size is known before texts are moved
    source, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    marked = docs.withColumns(dict(zip(levels, (domain_of(source), lang, source), strict=True)))
    return marked.join(ends, levels).filter((F.size(words_of(F.col("text"))) > 0) & (key <= F.col(end))).select(*docs.columns)


def order_key(seed: int, epoch: Column) -> Column:
    """Where a document stands in an epoch's seeded order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def with_tokens(docs: DataFrame) -> DataFrame:
    """LEVELS and tokens (words of the whole text) of documents."""
    return docs.withColumns({"domain": domain_of(F.coalesce(F.col("source"), F.lit(""))), "tokens": F.size(words_of(F.col("text"))).cast("long")})


def op10_mixing(spark, sf_dir):
    docs = with_tokens(table(spark, sf_dir, "documents")).select("doc_id", *LEVELS, "tokens")
    return mix(docs).select("doc_id", *LEVELS, "tokens", "epoch", "take_tokens")


def oracle() -> str:
    def weight(level):
        return "(CASE " + " ".join(f"WHEN {level} = '{v}' THEN {w}" for (at, v), w in WEIGHTS.items() if at == level) + " ELSE 1 END)" if any(at == level for at, _ in WEIGHTS) else "1"

    steps = []
    previous = f"SELECT *, (sum(leaf_tokens) OVER () * {BUDGET_PERCENT} // 100)::HUGEINT AS b, (leaf_tokens * {MAX_EPOCHS})::HUGEINT AS cap FROM leaf"
    for k, level in enumerate(LEVELS):
        parents = "".join(f"{x}, " for x in LEVELS[:k])
        by = f"PARTITION BY {', '.join(LEVELS[:k])}" if k else ""
        steps.append(f"""t{k} AS ({previous}),
n{k} AS (SELECT {parents}{level}, sum(cap)::HUGEINT AS capacity, any_value(b) AS b, {weight(level)}::HUGEINT AS w FROM t{k} GROUP BY {parents}{level}),
r{k} AS (SELECT *, b - coalesce(sum(capacity) OVER before, 0)::HUGEINT AS br, (sum(w) OVER ({by}) - coalesce(sum(w) OVER before, 0))::HUGEINT AS bw FROM n{k}
  WINDOW before AS ({by} ORDER BY capacity::DOUBLE / w::DOUBLE, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f{k} AS (SELECT *, capacity * bw <= w * br AS isfull FROM r{k}),
s{k} AS (SELECT {parents}{level}, CASE WHEN isfull THEN capacity ELSE (w * max(CASE WHEN NOT isfull THEN br END) OVER ({by})) // (max(CASE WHEN NOT isfull THEN bw END) OVER ({by})) END::HUGEINT AS got FROM f{k})""")
        previous = f"SELECT t{k}.* EXCLUDE (b), s{k}.got AS b FROM t{k} JOIN s{k} USING ({parents}{level})"
    return rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '(\d{{1,9}})$', 1) = '' THEN 'web' ELSE ['web', 'books', 'code'][(regexp_extract(source, '(\d{{1,9}})$', 1)::BIGINT % 3) + 1] END AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS leaf_tokens FROM d WHERE tokens > 0 GROUP BY ALL),
{', '.join(steps)},
l AS (SELECT domain, lang, source, least(b, cap)::BIGINT // leaf_tokens::BIGINT AS epochs, least(b, cap)::BIGINT % leaf_tokens::BIGINT AS rest FROM ({previous})),
e AS (SELECT d.*, epochs, rest, unnest(range(0, epochs + 1)) AS epoch FROM d JOIN l USING (domain, lang, source) WHERE tokens > 0),
o AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('{SEED}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT doc_id, domain, lang, source, tokens, epoch::INTEGER AS epoch, CASE WHEN epoch < epochs THEN tokens ELSE least(tokens, rest - before) END::BIGINT AS take_tokens
FROM o WHERE epoch < epochs OR before < rest
"""
