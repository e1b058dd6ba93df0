"""Catalog queries: chains of joins, latest versions, commit walks, merges, cursors, copies between schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelark.operators.graphs import _CHAIN, _chain, _edges, _heads, reachable
from tidelark.operators.listing import first_by, page
from tidelark.plans.standins import CHANGES, COMMITS, commits, file_changes, table
from tidelark.sources.stores import cut


def walk_commits(rows: DataFrame, since: Column | None = None, until: Column | None = None, author: str | None = None, skip_merges: bool = False, known: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Commits of a walk, newest first: bounds on time, part of the author's name, no merges, none of the known ones."""
    if since is not None:
        rows = rows.where(F.col("committed_at") >= since)
    if until is not None:
        rows = rows.where(F.col("committed_at") <= until)
    if author:
        rows = rows.where(F.contains(F.lower("author_email"), F.lit(author.lower())))
    if skip_merges:
        rows = rows.where(~F.col("is_merge_commit"))
    if known is not None:
        rows = rows.join(known.select("commit_sha"), "commit_sha", "left_anti")
    rows = rows.orderBy(F.desc("committed_at"), "commit_sha")
    return rows.limit(limit) if limit is not None else rows


def merge_bases(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """group, base: the best common ancestors of each group's heads (group, node), of any number: those that no other common
    ancestor of the group reaches.  Groups may share commits; a group without a common ancestor has no row.

    Whatever a common ancestor reaches is one too, so the best ones are those with no child among them.
    """
    heads = heads.select("group", "node").distinct()
    # A head is followed once, for all groups that have it.
    reach = reachable(edges, heads.select(F.col("node").alias("seed"), "node")).join(heads.select("group", F.col("node").alias("seed")), "seed")
    counts = heads.groupBy("group").agg(F.count("*").alias("_heads"))
    common = reach.groupBy("group", "node").agg(F.count("*").alias("_n")).join(counts, "group").where("_n = _heads")
    common = cut(common.select("group", "node"), "common")
    below = edges.select(F.col("src").alias("node"), "dst").join(common, "node").select("group", F.col("dst").alias("node")).distinct()
    return common.join(below, ["group", "node"], "left_anti").select("group", F.col("node").alias("base"))


def unravelled(edges: DataFrame, first_parents: DataFrame, heads: DataFrame) -> DataFrame:
    """Commits that heads reach, but not by first parents alone."""
    every = reachable(edges, heads).select("node").distinct()
    main = reachable(first_parents, heads).select("node").distinct()
    return every.join(main, "node", "left_anti")


def sections(docs: DataFrame, start: int, lines: int) -> DataFrame:
    """Lines start to start + lines - 1 of each text with the last heading before them; what is left and the next start."""
    x = docs.withColumn("_l", F.split("text", "\n"))
    heading = F.element_at(F.filter(F.slice("_l", 1, start), lambda t: F.startswith(t, F.lit("#"))), -1)
    n = F.size("_l")
    return x.select("doc_id", F.array_join(F.slice("_l", start, lines), "\n").alias("page"), F.when(F.size(F.filter(F.slice("_l", 1, start), lambda t: F.startswith(t, F.lit("#")))) > 0, heading).alias("heading"), F.greatest(F.lit(0), n - (start + lines - 1)).alias("remaining"), F.when(n > start + lines - 1, start + lines).alias("next"))


def rekeyed(rows: DataFrame, key: str, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(unique rows by content hash, mapping of old keys): rows of equal content become one, with the smallest old key."""
    hashed = rows.withColumn("content_hash", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in content]), 256))
    unique = hashed.groupBy("content_hash").agg(F.min(key).alias(key), *[F.min_by(c, key).alias(c) for c in content])
    return unique, hashed.select(F.col(key).alias("old_key"), "content_hash").join(unique.select("content_hash", F.col(key).alias("new_key")), "content_hash").select("old_key", "new_key")


def _orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders")


def _five(s: SparkSession, d: str) -> DataFrame:
    """Chain of joins from a line to its region."""
    t = lambda n: table(s, d, n)
    x = t("lineitem").select("l_orderkey", "l_linenumber").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return x.join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))


def _last(s: SparkSession, d: str, n: int) -> DataFrame:
    """The last n commits of each customer that has as many, as heads of a group."""
    x = _chain(s, d).withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("n"))))
    x = x.withColumn("many", F.max("n").over(Window.partitionBy("o_custkey"))).where((F.col("k") <= n) & (F.col("many") >= n))
    return x.select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("node"))


def _criss_cross(s: SparkSession, d: str) -> DataFrame:
    """Each commit goes on from those two and three before it; customers share commits in pairs."""
    w = Window.partitionBy("o_custkey").orderBy("n")
    c = _chain(s, d).select("o_custkey", "o_orderkey", "n", F.lag("o_orderkey", 2).over(w).alias("a"), F.lag("o_orderkey", 3).over(w).alias("b"))
    heads = c.where("n = 1").select((F.col("o_custkey") - 1).alias("o_custkey"), F.col("o_orderkey").alias("c"))
    x = c.join(heads, "o_custkey", "left").select(F.col("o_orderkey").alias("src"), F.explode(F.array("a", "b", F.when(F.expr("n = 1 AND o_custkey % 2 = 1"), F.col("c")))).alias("dst"))
    return cut(x.where("dst IS NOT NULL"), "edges")


QUERIES = {
    "j1_changes_with_commits": lambda s, d: file_changes(s, d).join(commits(s, d).dropDuplicates(["commit_sha"]).select("commit_sha", "author_email"), "commit_sha").groupBy("author_email").agg(F.count("*").alias("n")),
    "j2_left_fill": lambda s, d: table(s, d, "customer").select("c_custkey").join(_orders(s, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("most")), "c_custkey", "left").fillna(0.0, ["most"]),
    "j4_shared_and_own": lambda s, d: commits(s, d).where("branch_name <> 'main'").join(commits(s, d).where("branch_name = 'main'").select("commit_sha").distinct(), "commit_sha", "left_semi").groupBy("branch_name").agg(F.count("*").alias("shared")),
    "j5_join_chain": _five,
    "j9_multi_hop_exists": lambda s, d: table(s, d, "customer").join(_orders(s, d).join(table(s, d, "lineitem").where("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey"),
    "j23_latest_complete": lambda s, d: first_by(_orders(s, d).where("o_orderstatus = 'F'").join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "c_name"),
    "a14_page_with_total": lambda s, d: page(_orders(s, d).where("o_orderstatus = 'F'").withColumn("total", F.lit(_orders(s, d).where("o_orderstatus = 'F'").count()).cast("long")), "o_totalprice", "o_orderkey", True, 10).select("o_orderkey", "total"),
    "w5_latest_by_two_keys": lambda s, d: first_by(_orders(s, d), ["o_custkey", "o_orderpriority"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderpriority", "o_orderkey"),
    "w8_distinct_on": lambda s, d: first_by(table(s, d, "lineitem"), ["l_orderkey"], F.asc("l_shipdate"), F.asc("l_linenumber")).select("l_orderkey", "l_linenumber"),
    "w9_share_of_total": lambda s, d: table(s, d, "customer").select("c_custkey", (F.col("c_acctbal") / F.sum("c_acctbal").over(Window.partitionBy("c_nationkey"))).alias("share")),
    "w11_last_of_group": lambda s, d: _orders(s, d).groupBy(F.to_date("o_orderdate").alias("day")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("last")),
    "u1_union_all_branches": lambda s, d: _orders(s, d).select(F.col("o_custkey").alias("k"), F.lit("order").alias("via")).unionByName(table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("via"))).unionByName(table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("via"))).groupBy("k", "via").agg(F.count("*").alias("n")),
    "u6_drop_duplicates": lambda s, d: commits(s, d).dropDuplicates(["commit_sha"]).select("commit_sha", "sloc"),
    "u7_distinct_rows": lambda s, d: table(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct(),
    "u9_around_a_path": lambda s, d: table(s, d, "part").where("p_size <= 10").unionByName(table(s, d, "part").where("p_size >= 5")).dropDuplicates(["p_partkey"]).select("p_partkey"),
    "p14_commit_walk": lambda s, d: walk_commits(commits(s, d).dropDuplicates(["commit_sha"]), F.to_timestamp(F.lit("1995-01-01")), F.to_timestamp(F.lit("1996-12-31")), "USER1", True).select("commit_sha", "author_email"),
    "p21_kind_filters": lambda s, d: table(s, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(3, 4)).select("c_custkey"),
    "g5_merge_base": lambda s, d: merge_bases(_edges(s, d), _last(s, d, 2)).select(F.col("group").alias("o_custkey"), "base"),
    "g5_criss_cross": lambda s, d: merge_bases(_criss_cross(s, d), _last(s, d, 3)).select(F.col("group").alias("o_custkey"), "base"),
    "g8_unravelled_merges": lambda s, d: unravelled(_edges(s, d), _chain(s, d).where("p1 IS NOT NULL AND n % 10 <> 0").select(F.col("o_orderkey").alias("src"), F.col("p1").alias("dst")).unionByName(_chain(s, d).where("p3 IS NOT NULL AND n % 10 = 0").select(F.col("o_orderkey").alias("src"), F.col("p3").alias("dst"))), _heads(s, d).where("seed = 'main'")),
    "k8_sections": lambda s, d: sections(table(s, d, "documents").select("doc_id", F.concat(F.lit("# "), "text").alias("text")), 3, 4),
    "s29_rekeyed": lambda s, d: rekeyed(table(s, d, "documents").select("doc_id", "text"), "doc_id", ["text"])[1],
}
SQL = {
    "j1_changes_with_commits": f"WITH {COMMITS}, {CHANGES} SELECT author_email, count(*) AS n FROM changes c JOIN (SELECT DISTINCT commit_sha, author_email FROM commits) o ON o.commit_sha = c.commit_sha GROUP BY 1",
    "j2_left_fill": "SELECT c_custkey, coalesce(max(o_totalprice), 0) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "j4_shared_and_own": f"WITH {COMMITS} SELECT branch_name, count(*) AS shared FROM commits WHERE branch_name <> 'main' AND commit_sha IN (SELECT commit_sha FROM commits WHERE branch_name = 'main') GROUP BY 1",
    "j5_join_chain": "SELECT r_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "j9_multi_hop_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.09))",
    "j23_latest_complete": "SELECT o_custkey, o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "a14_page_with_total": "SELECT o_orderkey, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "w5_latest_by_two_keys": "SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "w8_distinct_on": "SELECT DISTINCT ON (l_orderkey) l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_shipdate, l_linenumber",
    "w9_share_of_total": "SELECT c_custkey, c_acctbal / sum(c_acctbal) OVER (PARTITION BY c_nationkey) AS share FROM customer",
    "w11_last_of_group": "SELECT CAST(o_orderdate AS DATE) AS day, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1",
    "u1_union_all_branches": "SELECT k, via, count(*) AS n FROM (SELECT o_custkey AS k, 'order' AS via FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier) GROUP BY 1, 2",
    "u6_drop_duplicates": f"WITH {COMMITS} SELECT DISTINCT commit_sha, sloc FROM commits",
    "u7_distinct_rows": "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem",
    "u9_around_a_path": "SELECT p_partkey FROM part WHERE p_size <= 10 UNION SELECT p_partkey FROM part WHERE p_size >= 5",
    "p14_commit_walk": f"WITH {COMMITS} SELECT DISTINCT commit_sha, author_email FROM commits WHERE committed_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' AND contains(author_email, 'user1') AND NOT is_merge_commit",
    "p21_kind_filters": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (3, 4)",
    "g5_merge_base": f"WITH {_CHAIN} SELECT o_custkey, o_orderkey AS base FROM ch QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC) = 2",
    "g5_criss_cross": f"""WITH RECURSIVE {_CHAIN}, x AS (SELECT o_custkey, o_orderkey, n, lag(o_orderkey, 2) OVER w AS a, lag(o_orderkey, 3) OVER w AS b, count(*) OVER (PARTITION BY o_custkey) AS many FROM ch WINDOW w AS (PARTITION BY o_custkey ORDER BY n)),
e AS (SELECT o_orderkey AS src, a AS dst FROM x WHERE a IS NOT NULL UNION SELECT o_orderkey, b FROM x WHERE b IS NOT NULL UNION SELECT x.o_orderkey, y.o_orderkey FROM x JOIN x y ON y.o_custkey = x.o_custkey + 1 AND y.n = 1 WHERE x.n = 1 AND x.o_custkey % 2 = 1),
h AS (SELECT o_custkey AS g, o_orderkey AS node FROM x WHERE many >= 3 AND n > many - 3), r(g, head, node) AS (SELECT g, node, node FROM h UNION SELECT g, head, dst FROM r JOIN e ON src = node),
c AS (SELECT g, node FROM r GROUP BY 1, 2 HAVING count(*) = 3) SELECT g AS o_custkey, node AS base FROM c WHERE NOT EXISTS (SELECT 1 FROM e JOIN c k ON k.node = e.src WHERE e.dst = c.node AND k.g = c.g)""",
    "g8_unravelled_merges": f"WITH RECURSIVE {_CHAIN}, m(node) AS (SELECT o_orderkey FROM ch WHERE nx IS NULL UNION SELECT CASE WHEN n % 10 = 0 THEN p3 ELSE p1 END FROM m JOIN ch ON o_orderkey = node WHERE n > 1) SELECT o_orderkey AS node FROM ch WHERE o_orderkey NOT IN (SELECT node FROM m)",
    "k8_sections": "WITH t AS (SELECT doc_id, string_split('# ' || text, chr(10)) AS l FROM documents) SELECT doc_id, coalesce(array_to_string(l[3:6], chr(10)), '') AS page, list_filter(l[1:3], lambda x: starts_with(x, '#'))[-1] AS heading, CAST(greatest(0, len(l) - 6) AS INT) AS remaining, CASE WHEN len(l) > 6 THEN 7 END AS next FROM t",
    "s29_rekeyed": "SELECT doc_id AS old_key, min(doc_id) OVER (PARTITION BY text) AS new_key FROM documents",
}
