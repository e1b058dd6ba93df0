"""Mixing sources to target weights by hierarchical budgeting.

The sources stand in a tree: domain, language within it, source within that.  A node's budget goes to its children by weight;
a child takes no more than its subtree can give (tokens times the epochs allowed), and what it can't use goes to its siblings
in proportion to their weights before anything is left to the levels above.  Since the capacity of a subtree limits the share
it is offered, a shortage reaches a node's siblings only when all the node's own children are exhausted.

Budgets are whole tokens and exact: a child is exhausted if capacity * (weights from it on) <= (budget - capacities before it)
* weight, children being ordered by capacity / weight; the rest share what is left, rounded down.

Each leaf is read in seeded epochs.  Whole epochs are taken whole; the last one is a prefix of the leaf in the order of a
seeded digest, as long as the tokens before a document are below what is left of the budget.  Prefix sums are two-level:
digest ranges of some 2,000 documents are summed first, and only the ranges' sums and the documents of one range meet in a
window, so a leaf with a third of all rows spreads over the cluster.

Only DataFrame functions are used.  Defined cases: null domain, lang or source is the value `unknown` there; null and empty
texts have 0 tokens and come along for free, but a leaf without tokens has no capacity and gives nothing; a node that the
weights don't name has weight `default_weight`; one of weight 0 gets nothing, and what only it could use stays unspent; ties in the digest are ordered by doc_id; rows that repeat a doc_id compete
separately; other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelark.llm.shared import cut, documents, only_ids

#: Documents in a digest range of a leaf, and ranges of a leaf at most.
RANGE_DOCS, MAX_RANGES = 2_000, 65_536
LEVELS = ("domain", "lang", "source")
DOMAIN_WEIGHTS = {("web",): 5, ("news",): 3, ("books",): 2}
LANGUAGE_WEIGHTS = {("en",): 6, ("de",): 2, ("fr",): 2, ("es",): 3}


def token_count(text: Column) -> Column:
    """Tokens of a text for budgeting: four bytes each, rounded up."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def _weight(column: str, weights: dict[tuple[str], int], default: int) -> Column:
    out = F.lit(default)
    for (name,), w in weights.items():
        out = F.when(F.col(column) == name, w).otherwise(out)
    return out.cast("long")


def split_budget(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """children (parent..., child, weight, capacity, budget of the parent) with the child's share as `share`."""
    order = [F.asc_nulls_last(F.col("capacity") / F.nullif(F.col("weight"), F.lit(0))), F.col(child)]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    group = Window.partitionBy(*parent)
    wide = "decimal(38,0)"
    x = children.withColumn("_before", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("_onward", F.sum("weight").over(onward))
    x = x.withColumn("_full", (F.col("weight") > 0) & (F.col("capacity").cast(wide) * F.col("_onward") <= (F.col("budget") - F.col("_before")).cast(wide) * F.col("weight")))
    x = x.withColumn("_used", F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(group), F.lit(0))).withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group))
    share = F.when(F.col("_full"), F.col("capacity")).when(F.col("weight") == 0, 0).otherwise(F.expr("(budget - _used) * weight div nullif(_open, 0)"))
    return x.withColumn("share", share.cast("long")).drop("_before", "_onward", "_full", "_used", "_open")


def leaf_budgets(leaves: DataFrame, budget: int, max_epochs: int, domain_weights: dict = DOMAIN_WEIGHTS, language_weights: dict = LANGUAGE_WEIGHTS, default_weight: int = 1) -> DataFrame:
    """domain, lang, source, tokens, share of the leaves (domain, lang, source, tokens) under a budget of tokens."""
    leaves = leaves.where("tokens > 0").withColumn("capacity", F.col("tokens") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    top = domains.withColumn("weight", _weight("domain", domain_weights, default_weight)).withColumn("budget", F.lit(budget).cast("long"))
    top = split_budget(top, [], "domain").select("domain", F.col("share").alias("budget"))
    mid = langs.withColumn("weight", _weight("lang", language_weights, default_weight)).join(top, "domain")
    mid = split_budget(mid, ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    low = leaves.withColumn("weight", F.lit(default_weight).cast("long")).join(mid, ["domain", "lang"])
    return split_budget(low, ["domain", "lang"], "source").select(*LEVELS, "tokens", "n_docs", "share")


def mix(docs: DataFrame, seed: str = "mix", percent: int = 50, max_epochs: int = 2, **weights) -> DataFrame:
    """doc_id, domain, lang, source, epoch, tokens of the documents (doc_id, domain, lang, source, tokens) chosen for a budget of `percent` of all tokens."""
    docs = docs.select("doc_id", *(F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in LEVELS), "tokens")
    leaves = cut(docs.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs")), "leaves")
    budget = (leaves.agg(F.sum("tokens")).first()[0] or 0) * percent // 100
    shares = cut(leaf_budgets(leaves, budget, max_epochs, **weights).withColumn("whole", F.expr("share div tokens")).withColumn("rest", F.col("share") % F.col("tokens")), "shares")
    rows = docs.join(shares.select(*LEVELS, "whole", "rest", "n_docs"), list(LEVELS))
    whole = rows.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("whole") - 1).cast("int"))))

    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), F.col("doc_id").cast("string")))
    ranges = F.least(F.lit(MAX_RANGES), F.ceil(F.col("n_docs") / RANGE_DOCS))
    part = rows.where("rest > 0").withColumn("digest", digest)
    part = cut(part.withColumn("range", F.expr("cast(conv(substr(digest, 1, 8), 16, 10) as long)") * ranges.cast("long")).withColumn("range", F.shiftright("range", 32)), "epochs")
    sums = part.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("sum"))
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sum")
    sums = cut(sums, "ranges")
    placed = part.join(sums, [*LEVELS, "range"]).where("before < rest")
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy(*LEVELS, "range").orderBy("digest", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    prefix = placed.withColumn("inside", inside).where("before + inside < rest").withColumn("epoch", F.col("whole").cast("int"))
    return whole.select("doc_id", *LEVELS, "epoch", "tokens").unionByName(prefix.select("doc_id", *LEVELS, "epoch", "tokens"))


def with_domain(docs: DataFrame) -> DataFrame:
    """documents with the columns that mixing needs; a source's number decides its domain."""
    n = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    domain = F.when(n == "", "unknown").otherwise(F.element_at(F.array(F.lit("web"), F.lit("news"), F.lit("books")), (F.expr("cast(right(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), 9) as int)") % 3 + 1)))
    return docs.select("doc_id", domain.alias("domain"), "lang", "source", token_count(F.col("text")).alias("tokens"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents chosen for a budget of 80 % of the tokens, each once."""
    chosen = cut(mix(with_domain(docs), percent=80, max_epochs=1).select("doc_id").distinct(), "chosen")
    return only_ids(docs, chosen)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(with_domain(documents(spark, sf_dir)))


_SPLIT = """
{name}_o AS (SELECT *, CAST(coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS before,
    CAST(sum(weight) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) AS onward FROM {name}_c),
{name}_f AS (SELECT *, capacity::HUGEINT * onward <= (budget - before) * weight AS is_full FROM {name}_o),
{name} AS (SELECT *, CASE WHEN is_full THEN capacity ELSE CAST((budget - coalesce(sum(capacity) FILTER (is_full) OVER (PARTITION BY {parent}), 0)) * weight // sum(weight) FILTER (NOT is_full) OVER (PARTITION BY {parent}) AS BIGINT) END AS share FROM {name}_f)
"""
QUERIES = {"op7_mixing": op7_mixing}
SQL = {
    "op7_mixing": f"""
WITH d AS (SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) = '' THEN 'unknown'
    ELSE ['web', 'news', 'books'][CAST(right(regexp_extract(source, '([0-9]+)$', 1), 9) AS INT) % 3 + 1] END AS domain,
    coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source, CAST(coalesce(ceil(strlen(text) / 4.0), 0) AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * 2 AS BIGINT) AS capacity, count(*) AS n_docs, 1 AS weight FROM d GROUP BY ALL HAVING sum(tokens) > 0),
top_c AS (SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity, CASE domain WHEN 'web' THEN 5 WHEN 'news' THEN 3 WHEN 'books' THEN 2 ELSE 1 END AS weight, (SELECT CAST(sum(tokens) AS BIGINT) * 50 // 100 FROM leaf) AS budget FROM leaf GROUP BY domain),
{_SPLIT.format(name="top", parent="1", child="domain")},
mid_c AS (SELECT l.domain, l.lang, CAST(sum(l.capacity) AS BIGINT) AS capacity, CASE l.lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 ELSE 1 END AS weight, any_value(t.share) AS budget FROM leaf l JOIN top t ON t.domain = l.domain GROUP BY l.domain, l.lang),
{_SPLIT.format(name="mid", parent="domain", child="lang")},
low_c AS (SELECT l.*, m.share AS budget FROM leaf l JOIN mid m ON m.domain = l.domain AND m.lang = l.lang),
{_SPLIT.format(name="low", parent="domain, lang", child="source")},
r AS (SELECT d.*, share // l.tokens AS whole, share % l.tokens AS rest FROM d JOIN low l ON l.domain = d.domain AND l.lang = d.lang AND l.source = d.source),
p AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('mix:' || whole || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT doc_id, domain, lang, source, CAST(unnest(range(whole)) AS INT) AS epoch, tokens FROM r
UNION ALL SELECT doc_id, domain, lang, source, CAST(whole AS INT), tokens FROM p WHERE before < rest
"""
}
