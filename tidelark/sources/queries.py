"""Queries over stores: each writes, reads back and returns what a scan of the table gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.plans.standins import CHANGES, COMMITS, commits, file_changes, table
from tidelark.sources.stores import ChunkStore, KeyedStore, ParquetStore, git_log, new_path, next_cursor, page_text, page_title, paged_log, read_json, write_json


def partitioned_scan(s: SparkSession, d: str) -> DataFrame:
    """File changes in partitions by type, read with a partition filter and two columns."""
    store, rows = ParquetStore(s, new_path(s, "store")), file_changes(s, d)
    store.write(rows, "1", "file_changes", partition_by="change_type")
    return store.read("1", "file_changes", rows.schema, ["commit_sha", "file_path", "addition_bytes"], F.col("change_type") == "added")


def appended(s: SparkSession, d: str) -> DataFrame:
    store, o = ParquetStore(s, new_path(s, "store")), table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    store.write(o.where("o_orderstatus = 'F'"), "1", "orders")
    store.append(o.where("o_orderstatus <> 'F'"), "1", "orders")
    return store.read("1", "orders", o.schema)


def merged_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks that are out of order, merged into one sorted table."""
    store, o, path = ChunkStore(s, new_path(s, "chunks")), table(s, d, "orders").select("o_orderkey", "o_orderdate"), new_path(s, "merged")
    for k, status in enumerate("OFP"):
        store.write(table(s, d, "orders").where(F.col("o_orderstatus") == status).select("o_orderkey", "o_orderdate"), k)
    store.merge_sorted(path, "o_orderdate", "o_orderkey")
    return s.read.schema(o.schema).parquet(path)


def merged_partitions(s: SparkSession, d: str) -> DataFrame:
    store, path = ChunkStore(s, new_path(s, "chunks")), new_path(s, "merged")
    store.write(file_changes(s, d).select("commit_sha", "change_type"), 0)
    store.merge_partitioned(path, "change_type")
    return s.read.parquet(path).groupBy("change_type").agg(F.count("*").alias("n")).select(F.col("change_type").cast("string"), "n")


def hot_table(s: SparkSession, d: str) -> DataFrame:
    """A keyed table after an upsert, an insert that ignores known keys, a deletion and a compaction."""
    rows = commits(s, d).groupBy("author_email").agg(F.count("*").alias("n"), F.max("committed_at").alias("last_at"))
    store = KeyedStore(s, new_path(s, "hot"), rows.schema, ["author_email"])
    store.upsert(rows.where("n % 2 = 0"), "last_at")
    store.insert_ignore(rows.withColumn("n", F.col("n") * 0 + 1))
    store.delete(F.col("author_email") == "user1@example.com")
    store.compact(1)
    return store.read().select("author_email", "n")


def json_mart(s: SparkSession, d: str) -> DataFrame:
    """A nested mart written as JSON lines and read back."""
    rows = table(s, d, "orders").groupBy("o_orderpriority").agg(F.struct(F.count("*").alias("n"), F.max("o_orderkey").alias("last")).alias("orders"))
    path = new_path(s, "mart")
    write_json(rows, path)
    return read_json(s, path, rows.schema).select("o_orderpriority", "orders.n", "orders.last")


def pages_as_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), page_title("html").alias("title"), page_text("html").alias("text"))


def exported_log(s: SparkSession, d: str) -> DataFrame:
    """Commits and changes written as an export of Git history and read from it."""
    numstat = F.concat_ws("\t", F.col("additions_lines").cast("string"), F.col("deletions_lines").cast("string"), "file_path")
    files = file_changes(s, d).groupBy("commit_sha").agg(F.array_join(F.collect_list(numstat), "\n").alias("files"))
    c = commits(s, d).dropDuplicates(["commit_sha"]).join(files, "commit_sha")
    at = F.date_format("committed_at", "yyyy-MM-dd'T'HH:mm:ssXXX")
    head = F.concat_ws("\x1f", "commit_sha", F.lit(""), F.lit("name"), "author_email", at, F.lit("a subject"))
    path = new_path(s, "git-log")
    c.select(F.concat(head, F.lit("\n\n"), "files").alias("value")).write.option("lineSep", "\x1e").text(path)
    found, changes = git_log(s, path)
    return changes.join(found, "commit_sha").select("commit_sha", "author_email", F.to_date("committed_at").alias("day"), "file_path", "additions_lines", "deletions_lines")


def logged_pages(s: SparkSession, d: str) -> DataFrame:
    """Events as pages of a log, each with the first entries of the next one too; read up to a cursor, then on from there."""
    e = table(s, d, "events").select(F.col("event_id").alias("log_id"), F.col("event_type").alias("type"), "user_id")
    page = F.explode(F.array_distinct(F.array(F.floor(F.col("log_id") / 100), F.floor((F.col("log_id") - 5) / 100)))).alias("page")
    pages = e.select("*", page).groupBy("page").agg(F.to_json(F.collect_list(F.struct("log_id", "type", "user_id"))).alias("value"))
    path, entry = new_path(s, "pages"), "log_id long, type string, user_id long"
    pages.where("page < 5").select("value").write.text(path)
    first = paged_log(s, path, entry)
    cursor = next_cursor(first)
    taken = first.withColumn("turn", F.lit(1))
    later = new_path(s, "pages")
    pages.where("page >= 4").select("value").write.text(later)
    return taken.unionByName(paged_log(s, later, entry, after=cursor).withColumn("turn", F.lit(2)))


QUERIES = {"s22_git_log": exported_log, "s24_paged_log": logged_pages, "s2_partitioned_scan": partitioned_scan, "s6_append": appended, "s9_merge_sorted": merged_chunks, "s10_merge_partitioned": merged_partitions, "s15_hot_table": hot_table, "s20_json_mart": json_mart, "s25_page_text": pages_as_text, "s1_pruned_scan": lambda s, d: table(s, d, "lineitem").where("l_quantity >= 30 AND l_shipdate < '1997-01-01'").select("l_orderkey", "l_quantity")}
SQL = {
    "s22_git_log": f"WITH {COMMITS}, {CHANGES} SELECT c.commit_sha, author_email, CAST(committed_at AS DATE) AS day, file_path, c.additions_lines, c.deletions_lines FROM changes c JOIN (SELECT DISTINCT commit_sha, author_email, committed_at FROM commits) o ON o.commit_sha = c.commit_sha",
    "s24_paged_log": "SELECT event_id AS log_id, event_type AS type, user_id, CASE WHEN event_id < 505 THEN 1 ELSE 2 END AS turn FROM events",
    "s1_pruned_scan": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_shipdate < TIMESTAMP '1997-01-01'",
    "s2_partitioned_scan": f"WITH {CHANGES} SELECT commit_sha, file_path, addition_bytes FROM changes WHERE change_type = 'added'",
    "s6_append": "SELECT o_orderkey, o_orderstatus FROM orders",
    "s9_merge_sorted": "SELECT o_orderkey, o_orderdate FROM orders",
    "s10_merge_partitioned": f"WITH {CHANGES} SELECT change_type, count(*) AS n FROM changes GROUP BY 1",
    "s15_hot_table": "WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem), c AS (SELECT 'user' || (o_custkey % 40) || '@example.com' AS author_email, sum(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END) AS n FROM orders JOIN o ON l_orderkey = o_orderkey GROUP BY 1) SELECT author_email, CAST(CASE WHEN n % 2 = 0 THEN n ELSE 1 END AS BIGINT) AS n FROM c WHERE author_email <> 'user1@example.com'",
    "s20_json_mart": "SELECT o_orderpriority, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1",
}
