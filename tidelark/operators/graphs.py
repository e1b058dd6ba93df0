"""Commit graphs, file trees and symbol graphs.

Closures double their reach in each round, so a chain of length n takes log2(n) rounds; each round is written to the shared
folder.  Reachability from given seeds follows a frontier instead, along chains by jumps that double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelark.functions import columns as C
from tidelark.operators import components
from tidelark.operators.access import _tree
from tidelark.operators.listing import first_by
from tidelark.plans.standins import CHANGES, COMMITS, commits, file_changes, table
from tidelark.sources.stores import cut


def closure(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(src, dst) of all nodes that a walk of one step or more joins.

    Round k goes on from the pairs at a distance of exactly 2^k and makes those up to twice as far, whose shortest walks all pass
    such a pair; what is known is neither made nor written again.
    """
    known = new = cut(edges.select("src", "dst").distinct().withColumn("steps", F.lit(1)), "closure")
    for k in range(max_rounds):
        far = new.where(F.col("steps") == 2**k).select("src", F.col("dst").alias("mid"))
        step = far.join(known.select(F.col("src").alias("mid"), "dst", "steps"), "mid").groupBy("src", "dst").agg((F.min("steps") + 2**k).cast("int").alias("steps"))
        new = cut(step.join(known.select("src", "dst"), ["src", "dst"], "left_anti"), "closure")
        if new.isEmpty():
            return known.select("src", "dst")
        known = known.unionByName(new)
    raise RuntimeError("the closure did not settle")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node) of the nodes that can be reached from each seed (seed, node), itself included.

    Each node's first parent (of edges (src, dst, first); the least dst where no edge is marked) makes a chain, whose jumps of
    2^k steps take a chain of length n in log2(n) rounds.  The other edges are followed from the new nodes of a turn, until a
    turn has none; that always comes, since only nodes that weren't known go on.
    """
    edges = edges if "first" in edges.columns else edges.withColumn("first", F.lit(False))
    jumps = [cut(edges.groupBy("src").agg(F.coalesce(F.min(F.when(F.col("first"), F.col("dst"))), F.min("dst")).alias("dst")), "jumps")]
    others = edges.select("src", "dst").join(jumps[0], ["src", "dst"], "left_anti").select(F.col("src").alias("node"), "dst")
    others = cut(others, "others")
    # Each row is written once, by the step that finds it; what is known is the union of the steps.
    front = cut(seeds.select("seed", "node").distinct(), "front")
    if front.isEmpty():
        return front
    known = front
    while True:
        new, k = front, 0
        while True:
            if k == len(jumps):
                jumps.append(cut(jumps[-1].select("src", F.col("dst").alias("mid")).join(jumps[-1].select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst"), "jumps"))
            # What is known from turns before has its whole chain known, so a chain that meets it ends there.
            step = new.join(jumps[k].withColumnRenamed("src", "node"), "node").select("seed", F.col("dst").alias("node")).distinct()
            step = cut(step.join(known, ["seed", "node"], "left_anti"), "step")
            if step.isEmpty():
                break
            new, known, k = new.unionByName(step), known.unionByName(step), k + 1
        step = new.join(others, "node").select("seed", F.col("dst").alias("node")).distinct()
        front = cut(step.join(known, ["seed", "node"], "left_anti"), "front")
        if front.isEmpty():
            return known
        known = known.unionByName(front)


def folded_sizes(chain: DataFrame, group: str, order: str, delta: str) -> DataFrame:
    """size(c) = max(0, size(parent) + delta) along a chain, without a fold: the running sum less its lowest point below 0."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = chain.withColumn("_sum", F.sum(delta).over(w))
    return x.withColumn("size", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w))).drop("_sum")


def tree_sizes(commits: DataFrame) -> DataFrame:
    """node, size of commits (node, parent, delta): size(c) = max(0, size(first parent) + delta) along the whole graph; a commit
    without a known parent begins at 0.  Nodes are unique.

    A commit's step is x -> max(low, x + add), and steps in a row are one of the same form; so each round joins a commit with the
    one its steps go back to, which doubles their number: a history of depth n takes log2(n) rounds.
    """
    add = F.col("delta").cast("long")
    rows = commits.select("node", "parent", F.lit(0).cast("long").alias("low"), add.alias("add"))
    known = rows.select(F.col("node").alias("parent")).distinct().withColumn("_known", F.lit(True))
    rows = cut(rows.join(known, "parent", "left").select("node", F.when(F.col("_known"), F.col("parent")).alias("parent"), "low", "add"), "sizes")
    done, open_ = rows.where("parent IS NULL"), rows.where("parent IS NOT NULL")
    n, left, rounds = rows.count(), open_.count(), 0
    while left:
        if 2**rounds > n:
            raise ValueError("parents go round in a circle")
        above = done.unionByName(open_).select(F.col("node").alias("parent"), F.col("parent").alias("_up"), F.col("low").alias("_low"), F.col("add").alias("_add"))
        step = open_.join(above, "parent").select("node", F.col("_up").alias("parent"), F.greatest("low", F.col("_low") + F.col("add")).alias("low"), (F.col("_add") + F.col("add")).alias("add"))
        step = cut(step, "sizes")
        done, open_ = done.unionByName(step.where("parent IS NULL")), step.where("parent IS NOT NULL")
        left, rounds = open_.count(), rounds + 1
    return done.select("node", F.greatest("low", "add").alias("size"))


def below(edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the subgraph that the roots (node) reach, themselves included."""
    nodes = cut(reachable(edges, roots.select(F.lit(0).alias("seed"), "node")).select("node"), "below")
    return nodes, edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi")


def transition_delta(before_ok: Column, after_ok: Column, before: Column, after: Column) -> Column:
    """What a changed file adds to the tree by whether it counted before and counts after."""
    return F.when(before_ok & after_ok, after - before).when(after_ok, after).when(before_ok, -before).otherwise(0)


def tree_status(files: DataFrame) -> DataFrame:
    """Status of every directory by those of the files below: REMOVED if all are (never the root), ADDED if all are, else
    MODIFIED if any changed, else UNCHANGED."""
    x = files.select(F.explode(C.ancestors("path")).alias("directory"), "status")
    every = lambda s: F.bool_and(F.col("status") == s)
    status = F.when(every("REMOVED") & (F.first("directory") != ""), "REMOVED").when(every("ADDED") & (F.first("directory") != ""), "ADDED").when(F.bool_or(F.col("status") != "UNCHANGED"), "MODIFIED").otherwise("UNCHANGED")
    return x.groupBy("directory").agg(status.alias("status"), F.count("*").alias("files"))


def merkle(files: DataFrame) -> DataFrame:
    """(path, hash) of files (path, hash) and all directories above them: SHA-256 of the sorted hashes of the children, joined by |.

    One aggregation for each level, the deepest first; the number of levels reaches the driver.
    """
    level = cut(files.select("path", "hash", C.depth("path").alias("depth")), "merkle")
    deepest = level.agg(F.max("depth")).first()[0] or 0
    done, front = level.select("path", "hash"), level.limit(0)
    for k in range(deepest, 0, -1):
        here = level.where(F.col("depth") == k).select("path", "hash").unionByName(front.select("path", "hash"))
        hashed = F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), "|"), 256)
        front = cut(here.groupBy(C.parent("path").alias("path")).agg(hashed.alias("hash")), "merkle")
        done = done.unionByName(front)
    return done


def topological(files: DataFrame) -> DataFrame:
    """Positions of paths so that children come before their parents, for each first segment.

    Numbered within ranges of the order, after the counts of the ranges before: a root of any size is dealt over many tasks.
    """
    x = files.select("path", C.depth("path").alias("depth"), F.split("path", "/")[0].alias("_root"))
    x = cut(x.repartitionByRange("_root", F.desc("depth"), "path").withColumn("_range", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_root").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = x.groupBy("_root", "_range").agg(F.count("*").alias("_n")).select(F.col("_root").alias("_r"), F.col("_range").alias("_k"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_root", "_range").orderBy(F.desc("depth"), "path"))
    x = x.withColumn("position", here).join(before, F.col("_root").eqNullSafe(F.col("_r")) & (F.col("_range") == F.col("_k")))
    return x.select("path", "depth", (F.col("position") + F.col("_before")).cast("int").alias("position"))


def link_uses(uses: DataFrame, definitions: DataFrame, visible: DataFrame) -> DataFrame:
    """use_id, def_id where exactly one definition of the name is visible from the use's file."""
    seen = visible.select("file", F.col("target").alias("def_file"))
    found = uses.join(definitions, "name").join(seen, ["file", "def_file"], "left_semi")
    return found.groupBy("use_id").agg(F.count("*").alias("n"), F.min("def_id").alias("def_id")).where("n = 1").drop("n")


def inverted(links: DataFrame) -> DataFrame:
    """Uses of each definition."""
    return links.groupBy("def_id").agg(F.count("*").alias("uses"), F.min("use_id").alias("first_use"))


def _chain(s: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as a chain of commits; each tenth is a merge of the one three before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("n"), F.lag("o_orderkey").over(w).alias("p1"), F.lag("o_orderkey", 3).over(w).alias("p3"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    c = _chain(s, d)
    first = c.where("p1 IS NOT NULL").select(F.col("o_orderkey").alias("src"), F.col("p1").alias("dst"), F.lit(True).alias("first"))
    return cut(first.unionByName(c.where("p3 IS NOT NULL AND n % 10 = 0").select(F.col("o_orderkey").alias("src"), F.col("p3").alias("dst"), F.lit(False).alias("first"))), "edges")


def _heads(s: SparkSession, d: str) -> DataFrame:
    """The last commit of a customer is on main, the one before on dev."""
    last = table(s, d, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))))
    return last.where("k <= 2").select(F.when(F.col("k") == 1, "main").otherwise("dev").alias("seed"), F.col("o_orderkey").alias("node"))


def _membership(s: SparkSession, d: str) -> DataFrame:
    r = reachable(_edges(s, d), _heads(s, d))
    return r.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("seed")), ",").alias("branches"))


def _statuses(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return _tree(s, d).select("path", F.when(k % 11 == 0, "REMOVED").when(k % 13 == 0, "ADDED").when(k % 17 == 0, "MODIFIED").otherwise("UNCHANGED").alias("status"))


def _functional(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_size").alias("src"), (F.col("p_size") * 3 % 50 + 1).alias("dst")).distinct()


def _symbols(s: SparkSession, d: str) -> DataFrame:
    name = lambda k, seg: F.concat(F.col(seg), F.lit("_"), (F.col(k) % 97).cast("string"))
    uses = table(s, d, "supplier").select(F.col("s_suppkey").alias("use_id"), F.col("s_nationkey").alias("file"), F.concat(F.element_at(F.array(*map(F.lit, ["BUILDING", "MACHINERY", "AUTOMOBILE"])), (F.col("s_suppkey") % 3 + 1).cast("int")), F.lit("_"), (F.col("s_suppkey") % 97).cast("string")).alias("name"))
    defs = table(s, d, "customer").select(F.col("c_custkey").alias("def_id"), F.col("c_nationkey").alias("def_file"), name("c_custkey", "c_mktsegment").alias("name"))
    n = table(s, d, "nation")
    visible = n.select(F.col("n_nationkey").alias("file"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("target"), "n_regionkey"), "n_regionkey").select("file", "target")
    return link_uses(uses, defs, visible)


def _tree_sizes(s: SparkSession, d: str) -> DataFrame:
    """Sizes along first parents that branch: each tenth commit goes on from the one three before."""
    c = _chain(s, d)
    parent = F.when((F.col("n") % 10 == 0) & F.col("p3").isNotNull(), F.col("p3")).otherwise(F.col("p1"))
    delta = F.floor(F.col("o_totalprice") - 100000 * F.when(F.col("n") == 1, 0).otherwise(1.2)).cast("long")
    return tree_sizes(c.select(F.col("o_orderkey").alias("node"), parent.alias("parent"), delta.alias("delta")))


_CHAIN = "ch AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS n, lag(o_orderkey) OVER w AS p1, lag(o_orderkey, 3) OVER w AS p3, lead(o_orderkey) OVER w AS nx FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"
_TREE = "t AS (SELECT 'r' || n_regionkey || '/' || n_name || '/' || c_name AS path, c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_LINKS = """u AS (SELECT s_suppkey AS use_id, s_nationkey AS file, ['BUILDING', 'MACHINERY', 'AUTOMOBILE'][s_suppkey % 3 + 1] || '_' || (s_suppkey % 97) AS name FROM supplier), f AS (SELECT c_custkey AS def_id, c_nationkey AS def_file, c_mktsegment || '_' || (c_custkey % 97) AS name FROM customer),
k AS (SELECT use_id, min(def_id) AS def_id FROM u JOIN f ON f.name = u.name JOIN nation a ON a.n_nationkey = file JOIN nation b ON b.n_nationkey = def_file AND a.n_regionkey = b.n_regionkey GROUP BY 1 HAVING count(*) = 1)"""
QUERIES = {
    "g1_branch_membership": _membership,
    "g2_ancestor_difference": lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("node")).join(reachable(_edges(s, d), _heads(s, d).where("seed = 'dev'")), "node", "left_anti").select("node"),
    "g3_folded_sizes": lambda s, d: folded_sizes(_chain(s, d).withColumn("delta", F.floor(F.col("o_totalprice") - 100000 * F.when(F.col("n") == 1, 0).otherwise(1.2)).cast("long")), "o_custkey", "n", "delta").select("o_orderkey", "size"),
    "g3_tree_sizes": _tree_sizes,
    "g15_subgraph": lambda s, d: below(_edges(s, d), _heads(s, d).where("seed = 'dev'").select("node"))[1].select("src", "dst").distinct(),
    "g4_transition_delta": lambda s, d: file_changes(s, d).groupBy("commit_sha").agg(F.sum(transition_delta(F.col("change_type") != "added", (F.col("change_type") != "deleted") & C.is_analyzable("file_path"), F.col("deletion_bytes"), F.col("addition_bytes"))).cast("long").alias("delta")),
    "g6_is_merged": lambda s, d: _heads(s, d).join(reachable(_edges(s, d), _heads(s, d).where("seed = 'main'")).select("node").distinct().withColumn("merged", F.lit(True)), "node", "left").select("node", "seed", F.coalesce("merged", F.lit(False)).alias("merged")),
    "g7_first_own_commit": lambda s, d: commits(s, d).join(commits(s, d).where("branch_name = 'main'").select("commit_sha").distinct(), "commit_sha", "left_anti").groupBy("codebase_id", "branch_name").agg(F.min_by("commit_sha", F.struct("committed_at", "commit_sha")).alias("first_sha")),
    "g9_scc_reach": lambda s, d: components.components_with_reach(_functional(s, d)),
    "g9_closure": lambda s, d: closure(_edges(s, d)).groupBy("src").agg(F.count("*").alias("ancestors")),
    "g10_link_uses": _symbols,
    "g11_inverted": lambda s, d: inverted(_symbols(s, d)),
    "g12_tree_status": lambda s, d: tree_status(_statuses(s, d)),
    "g13_topological": lambda s, d: topological(_tree(s, d)).select("path", "position"),
    "g14_merkle": lambda s, d: merkle(_tree(s, d).select("path", F.sha2("path", 256).alias("hash"))),
    "g17_file_history": lambda s, d: first_by(file_changes(s, d).join(commits(s, d).dropDuplicates(["commit_sha"]).select("commit_sha", "committed_at"), "commit_sha"), ["file_path"], F.desc("committed_at"), F.asc("commit_sha"), n=5).select("file_path", "commit_sha"),
}
SQL = {
    "g1_branch_membership": f"WITH {_CHAIN} SELECT o_orderkey AS node, CASE WHEN nx IS NULL THEN 'main' ELSE 'dev,main' END AS branches FROM ch",
    "g2_ancestor_difference": f"WITH {_CHAIN} SELECT o_orderkey AS node FROM ch WHERE nx IS NULL",
    "g3_folded_sizes": f"WITH {_CHAIN}, x AS (SELECT *, CAST(floor(o_totalprice - 100000 * CASE WHEN n = 1 THEN 0 ELSE 1.2::DOUBLE END) AS BIGINT) AS delta FROM ch), y AS (SELECT *, sum(delta) OVER (PARTITION BY o_custkey ORDER BY n) AS s FROM x) SELECT o_orderkey, CAST(s - least(0, min(s) OVER (PARTITION BY o_custkey ORDER BY n)) AS BIGINT) AS size FROM y",
    "g3_tree_sizes": f"WITH RECURSIVE {_CHAIN}, x AS (SELECT o_orderkey AS node, CASE WHEN n % 10 = 0 THEN p3 ELSE p1 END AS parent, CAST(floor(o_totalprice - 100000 * CASE WHEN n = 1 THEN 0 ELSE 1.2::DOUBLE END) AS BIGINT) AS delta FROM ch), r(node, size) AS (SELECT node, greatest(0, delta) FROM x WHERE parent IS NULL UNION ALL SELECT x.node, greatest(0, r.size + x.delta) FROM r JOIN x ON x.parent = r.node) SELECT node, CAST(size AS BIGINT) AS size FROM r",
    "g15_subgraph": f"WITH {_CHAIN} SELECT o_orderkey AS src, p1 AS dst FROM ch WHERE nx IS NOT NULL AND p1 IS NOT NULL UNION SELECT o_orderkey, p3 FROM ch WHERE nx IS NOT NULL AND p3 IS NOT NULL AND n % 10 = 0",
    "g4_transition_delta": f"WITH {CHANGES} SELECT commit_sha, CAST(sum(CASE WHEN change_type <> 'added' AND change_type <> 'deleted' AND file_path NOT LIKE '%.svg' THEN addition_bytes - deletion_bytes WHEN change_type <> 'deleted' AND file_path NOT LIKE '%.svg' THEN addition_bytes WHEN change_type <> 'added' THEN -deletion_bytes ELSE 0 END) AS BIGINT) AS delta FROM changes GROUP BY 1",
    "g6_is_merged": f"WITH {_CHAIN} SELECT o_orderkey AS node, CASE WHEN nx IS NULL THEN 'main' ELSE 'dev' END AS seed, TRUE AS merged FROM ch QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC) <= 2",
    "g7_first_own_commit": f"WITH {COMMITS} SELECT codebase_id, branch_name, arg_min(commit_sha, (committed_at, commit_sha)) AS first_sha FROM commits WHERE commit_sha NOT IN (SELECT commit_sha FROM commits WHERE branch_name = 'main') GROUP BY 1, 2",
    "g9_scc_reach": "WITH RECURSIVE e AS (SELECT DISTINCT p_size AS src, p_size * 3 % 50 + 1 AS dst FROM part), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r(src, dst) AS (SELECT node, node FROM v UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT a.src AS node, min(CASE WHEN b.src IS NOT NULL THEN a.dst END) AS component, count(*) AS reach FROM r a LEFT JOIN r b ON b.src = a.dst AND b.dst = a.src GROUP BY 1",
    "g9_closure": f"WITH {_CHAIN} SELECT o_orderkey AS src, n - 1 AS ancestors FROM ch WHERE n > 1",
    "g10_link_uses": f"WITH {_LINKS} SELECT * FROM k",
    "g11_inverted": f"WITH {_LINKS} SELECT def_id, count(*) AS uses, min(use_id) AS first_use FROM k GROUP BY 1",
    "g12_tree_status": f"WITH {_TREE}, x AS (SELECT unnest(['', string_split(path, '/')[1], string_split(path, '/')[1] || '/' || string_split(path, '/')[2]]) AS directory, CASE WHEN c_custkey % 11 = 0 THEN 'REMOVED' WHEN c_custkey % 13 = 0 THEN 'ADDED' WHEN c_custkey % 17 = 0 THEN 'MODIFIED' ELSE 'UNCHANGED' END AS status FROM t) SELECT directory, CASE WHEN bool_and(status = 'REMOVED') AND directory <> '' THEN 'REMOVED' WHEN bool_and(status = 'ADDED') AND directory <> '' THEN 'ADDED' WHEN bool_or(status <> 'UNCHANGED') THEN 'MODIFIED' ELSE 'UNCHANGED' END AS status, count(*) AS files FROM x GROUP BY 1",
    "g13_topological": f"WITH {_TREE} SELECT path, CAST(row_number() OVER (PARTITION BY string_split(path, '/')[1] ORDER BY len(string_split(path, '/')) DESC, path) AS INT) AS position FROM t",
    "g14_merkle": f"WITH {_TREE}, a AS (SELECT path, sha256(path) AS hash, string_split(path, '/') AS p FROM t), b AS (SELECT p[1] || '/' || p[2] AS path, sha256(string_agg(hash, '|' ORDER BY hash)) AS hash FROM a GROUP BY 1), c AS (SELECT string_split(path, '/')[1] AS path, sha256(string_agg(hash, '|' ORDER BY hash)) AS hash FROM b GROUP BY 1) SELECT path, hash FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT '', sha256(string_agg(hash, '|' ORDER BY hash)) FROM c",
    "g17_file_history": f"WITH {COMMITS}, {CHANGES}, o AS (SELECT DISTINCT commit_sha, committed_at FROM commits) SELECT file_path, c.commit_sha FROM changes c JOIN o ON o.commit_sha = c.commit_sha QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY committed_at DESC, c.commit_sha) <= 5",
}
