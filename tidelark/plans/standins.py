"""Commits, file changes and ledgers made of the star-schema tables, for queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.functions import columns as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order line: a change of one file by one commit."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    extension = F.element_at(F.array(*map(F.lit, [".py", ".java", ".go", ".rs", ".svg", ".md"])), (F.col("p_size") % 6 + 1).cast("int"))
    path = F.concat(F.lit("src/"), F.lower(F.translate("p_brand", "#", "")), F.lit("/mod"), (F.col("p_size") % 4).cast("string"), F.lit("/f"), F.col("p_partkey").cast("string"), extension)
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("commit_sha"),
        path.alias("file_path"),
        F.floor("l_quantity").cast("long").alias("additions_lines"),
        F.floor(F.col("l_discount") * 100).cast("long").alias("deletions_lines"),
        F.floor("l_extendedprice").cast("long").alias("addition_bytes"),
        F.floor(F.col("l_extendedprice") * F.col("l_discount")).cast("long").alias("deletion_bytes"),
        F.when(F.col("l_returnflag") == "A", "added").when(F.col("l_returnflag") == "R", "deleted").otherwise("modified").alias("change_type"),
    )


CHANGES = """changes AS (SELECT 'c' || l_orderkey AS commit_sha, 'src/' || lower(translate(p_brand, '#', '')) || '/mod' || (p_size % 4) || '/f' || p_partkey || ['.py', '.java', '.go', '.rs', '.svg', '.md'][p_size % 6 + 1] AS file_path,
  CAST(floor(l_quantity) AS BIGINT) AS additions_lines, CAST(floor(l_discount * 100) AS BIGINT) AS deletions_lines, CAST(floor(l_extendedprice) AS BIGINT) AS addition_bytes, CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS deletion_bytes,
  CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'deleted' ELSE 'modified' END AS change_type FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each commit and branch that holds it."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("files_changed"),
        F.sum(F.floor("l_quantity")).cast("long").alias("additions_lines"),
        F.sum(F.floor(F.col("l_discount") * 100)).cast("long").alias("deletions_lines"),
        F.sum(F.floor("l_extendedprice")).cast("long").alias("addition_bytes"),
        F.sum(F.floor(F.col("l_extendedprice") * F.col("l_discount"))).cast("long").alias("deletion_bytes"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    branch = F.lower(F.substring("o_orderpriority", 3, 20))
    on = F.when(F.col("o_orderkey") % 4 == 0, F.array(branch)).otherwise(F.array(F.lit("main"), branch))
    x = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("branch_name", F.explode(on))
    churn, net = F.col("additions_lines") + F.col("deletions_lines"), F.col("additions_lines") - F.col("deletions_lines")
    patch = F.col("addition_bytes") + F.col("deletion_bytes")
    return x.select(
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("commit_sha"),
        F.concat(F.lit("repo"), (F.col("o_custkey") % 3).cast("string")).alias("codebase_id"),
        "branch_name",
        F.col("o_orderdate").cast("timestamp").alias("committed_at"),
        F.concat(F.lit("user"), (F.col("o_custkey") % 40).cast("string"), F.lit("@example.com")).alias("author_email"),
        (F.col("o_orderkey") % 20 == 0).alias("is_merge_commit"),
        "files_changed",
        "additions_lines",
        "deletions_lines",
        net.alias("net_lines"),
        churn.alias("churn_lines"),
        "addition_bytes",
        "deletion_bytes",
        patch.alias("patch_bytes"),
        (F.col("addition_bytes") - F.col("deletion_bytes")).alias("net_bytes"),
        C.bytes_to_sloc(patch).alias("sloc"),
        F.floor("o_totalprice").cast("long").alias("tree_bytes"),
        C.size_category(churn).alias("size_category"),
        C.is_refactor("additions_lines", "deletions_lines").alias("is_refactor"),
    )


COMMITS = """commits AS (SELECT 'c' || o_orderkey AS commit_sha, 'repo' || (o_custkey % 3) AS codebase_id, unnest(CASE WHEN o_orderkey % 4 = 0 THEN [lower(substr(o_orderpriority, 3, 20))] ELSE ['main', lower(substr(o_orderpriority, 3, 20))] END) AS branch_name,
  o_orderdate AS committed_at, 'user' || (o_custkey % 40) || '@example.com' AS author_email, o_orderkey % 20 = 0 AS is_merge_commit, files_changed, additions_lines, deletions_lines, additions_lines - deletions_lines AS net_lines, additions_lines + deletions_lines AS churn_lines,
  addition_bytes, deletion_bytes, addition_bytes + deletion_bytes AS patch_bytes, addition_bytes - deletion_bytes AS net_bytes, CAST(floor(abs(addition_bytes + deletion_bytes) / 50) AS BIGINT) AS sloc, CAST(floor(o_totalprice) AS BIGINT) AS tree_bytes,
  CASE WHEN additions_lines + deletions_lines < 10 THEN 'tiny' WHEN additions_lines + deletions_lines < 50 THEN 'small' WHEN additions_lines + deletions_lines < 200 THEN 'medium' ELSE 'large' END AS size_category,
  additions_lines > 0 AND deletions_lines > 0 AND abs(additions_lines - deletions_lines) < 0.1 * (additions_lines + deletions_lines) AS is_refactor
  FROM orders JOIN (SELECT l_orderkey, count(*) AS files_changed, CAST(sum(floor(l_quantity)) AS BIGINT) AS additions_lines, CAST(sum(floor(l_discount * 100)) AS BIGINT) AS deletions_lines, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS addition_bytes, CAST(sum(floor(l_extendedprice * l_discount)) AS BIGINT) AS deletion_bytes FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""
