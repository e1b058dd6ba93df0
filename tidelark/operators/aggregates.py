"""Repository analytics: roll-ups of commits and file changes.

All roll-ups are one hash aggregation (partial before the shuffle); values of the latest row come from max_by over (time, sha)
instead of a join with a sorted copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelark.functions import columns as C
from tidelark.plans import standins as S

SUMS = ["additions_lines", "deletions_lines", "net_lines", "churn_lines", "addition_bytes", "deletion_bytes", "patch_bytes", "sloc", "files_changed"]


def one_per_commit(commits: DataFrame) -> DataFrame:
    """One row for each repository and commit: branch copies agree in all but the branch."""
    return commits.dropDuplicates(["codebase_id", "commit_sha"])


def _sums(names: list[str] = SUMS) -> list[Column]:
    return [F.sum(c).cast("long").alias(f"total_{c}") for c in names]


def latest(column: str, by: tuple[str, str] = ("committed_at", "commit_sha")) -> Column:
    return F.max_by(column, F.struct(*by))


def repository_summary(commits: DataFrame) -> DataFrame:
    """One row for each repository; branches are counted before copies go."""
    branches = commits.groupBy("codebase_id").agg(F.countDistinct("branch_name").alias("total_branches"))
    once = one_per_commit(commits).groupBy("codebase_id").agg(
        F.count("*").alias("total_commits"),
        F.countDistinct("author_email").alias("total_contributors"),
        *_sums(),
        F.min("committed_at").alias("first_commit_at"),
        F.max("committed_at").alias("last_commit_at"),
        F.count_if("is_merge_commit").alias("merge_commits"),
        F.count_if("is_refactor").alias("refactors"),
        latest("tree_bytes").alias("tree_bytes"),
        latest("commit_sha").alias("head_sha"),
    )
    out = once.join(branches, "codebase_id")
    return out.withColumn("churn_ratio", C.safe_ratio("total_deletions_lines", "total_additions_lines")).withColumn("tree_sloc", C.bytes_to_sloc("tree_bytes"))


def daily_rollup(commits: DataFrame) -> DataFrame:
    """One row for each repository and day, with the last tree size of the day and the running net lines."""
    day = one_per_commit(commits).groupBy("codebase_id", F.to_date("committed_at").alias("day")).agg(
        F.count("*").alias("commits"), F.countDistinct("author_email").alias("contributors"), *_sums(), latest("tree_bytes").alias("tree_bytes")
    )
    running = Window.partitionBy("codebase_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return day.withColumn("cumulative_net_lines", F.sum("total_net_lines").over(running).cast("long"))


def monthly_rollup(commits: DataFrame) -> DataFrame:
    """One row for each repository and month; net_sloc holds the sum of net bytes, as the marts have it."""
    return one_per_commit(commits).groupBy("codebase_id", C.month("committed_at").alias("month")).agg(
        F.count("*").alias("commits"), F.countDistinct("author_email").alias("contributors"), F.sum("additions_lines").cast("long").alias("additions"), F.sum("net_bytes").cast("long").alias("net_sloc"), F.max("tree_bytes").alias("max_tree_bytes"), F.avg("churn_lines").alias("mean_churn")
    )


def branch_metrics(commits: DataFrame, default: str = "main") -> DataFrame:
    """Each branch against the default branch: shared and own commits, divergence point, head."""
    on_default = commits.where(F.col("branch_name") == default).select("codebase_id", "commit_sha").distinct().withColumn("shared", F.lit(True))
    x = commits.join(on_default, ["codebase_id", "commit_sha"], "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    own, key = ~F.col("shared"), F.struct("committed_at", "commit_sha")
    out = x.groupBy("codebase_id", "branch_name").agg(
        F.count("*").alias("commits"),
        F.count_if(own).alias("unique_commits"),
        F.sum(F.when(own, F.col("additions_lines")).otherwise(0)).cast("long").alias("unique_additions"),
        F.sum(F.when(own, F.col("sloc")).otherwise(0)).cast("long").alias("unique_sloc"),
        F.max_by("commit_sha", key).alias("head_sha"),
        F.max_by(F.when(F.col("shared"), F.col("commit_sha")), F.when(F.col("shared"), key)).alias("divergence_sha"),
        F.max_by("tree_bytes", key).alias("head_tree_bytes"),
        F.max_by(F.when(F.col("shared"), F.col("tree_bytes")), F.when(F.col("shared"), key)).alias("divergence_tree_bytes"),
        F.max("committed_at").alias("last_commit_at"),
    )
    return out.withColumn("tree_delta", F.col("head_tree_bytes") - F.coalesce("divergence_tree_bytes", F.lit(0)))


def branch_status(branches: DataFrame, as_of: Column, default: str = "main", stale_days: int = 30) -> Column:
    """merged > deleted > default > stale > active; a branch without a date is active."""
    stale = F.col("last_commit_at") < as_of - F.expr(f"INTERVAL {stale_days} DAYS")
    return F.when(F.col("is_merged"), "merged").when(F.col("is_deleted"), "deleted").when(F.col("branch_name") == default, "default").when(stale, "stale").otherwise("active")


def contributors(commits: DataFrame, as_of: Column) -> DataFrame:
    """One row for each author; a commit counts once for each branch it is on."""
    return commits.groupBy("codebase_id", "author_email").agg(
        F.count("*").alias("total_commits"),
        *[F.count_if(C.within_days("committed_at", as_of, d)).alias(f"commits_{d}d") for d in (30, 90, 365)],
        F.array_join(F.array_sort(F.collect_set("branch_name")), ",").alias("branches"),
        F.expr("mode() WITHIN GROUP (ORDER BY branch_name)").alias("primary_branch"),
        F.avg("sloc").alias("mean_sloc"),
        F.sum("sloc").cast("long").alias("total_sloc"),
        F.min("committed_at").alias("first_commit_at"),
        F.max("committed_at").alias("last_commit_at"),
    )


def directory_ownership(changes: DataFrame, commits: DataFrame, top: int = 10) -> DataFrame:
    """The authors of each directory by churn, with their share; bytes become lines row by row before they are summed.

    Changes that name their repository meet its commits only; without that column a commit of several repositories counts once.
    """
    key = ["codebase_id", "commit_sha"] if "codebase_id" in changes.columns else ["commit_sha"]
    once = commits.select(*key, "author_email", "committed_at").dropDuplicates(key)
    x = changes.join(once, key).withColumn("directory", C.directory_of("file_path")).withColumn("churn", F.floor(F.col("addition_bytes") / 50) + F.floor(F.col("deletion_bytes") / 50))
    by = x.groupBy("directory", "author_email").agg(F.sum("churn").cast("long").alias("churn_sloc"), F.countDistinct("commit_sha").alias("commits"), F.countDistinct("committed_at").alias("active_days"))
    group = Window.partitionBy("directory")
    by = by.withColumn("share", F.col("churn_sloc") * 100 / F.nullif(F.sum("churn_sloc").over(group), F.lit(0))).withColumn("contributors", F.count("*").over(group))
    ranked = by.withColumn("rank", F.row_number().over(group.orderBy(F.desc("churn_sloc"), "author_email")))
    return ranked.where(F.col("rank") <= top).withColumn("share", F.coalesce("share", F.lit(0.0)))


def file_ownership(changes: DataFrame) -> DataFrame:
    """Share of each author in a file by net lines; equal shares where all net lines are 0; blank paths and authors don't count."""
    by = changes.where("file_path <> '' AND author_email <> ''").groupBy("file_path", "author_email").agg(F.sum(F.col("additions_lines") - F.col("deletions_lines")).cast("long").alias("net_lines"))
    group = Window.partitionBy("file_path")
    total = F.sum(F.abs("net_lines")).over(group)
    return by.withColumn("share", F.when(total == 0, F.lit(100.0) / F.count("*").over(group)).otherwise(F.abs("net_lines") * 100 / total))


def primary_language(changes: DataFrame) -> DataFrame:
    by = changes.withColumn("language", C.language_of("file_path")).where("language IS NOT NULL").groupBy("language").agg(F.sum("addition_bytes").cast("long").alias("bytes"))
    return by.agg(F.max_by("language", F.struct("bytes", "language")).alias("language"), F.max("bytes").alias("bytes"))


def directory_rollup(files: DataFrame, ignored: tuple[str, ...] = ("Markdown", "Text", "JSON", "YAML")) -> DataFrame:
    """Totals of every directory over all files below it; the top language leaves out `ignored` unless there is no other."""
    x = files.select(F.explode(C.ancestors("file_path")).alias("directory"), F.coalesce(C.language_of("file_path"), F.lit("Unknown")).alias("language"), "bytes")
    by = x.groupBy("directory", "language").agg(F.count("*").alias("files"), F.sum("bytes").cast("long").alias("bytes"))
    main = F.struct((~F.col("language").isin(*ignored)).cast("int"), "bytes", "language")
    return by.groupBy("directory").agg(
        F.sum("files").cast("long").alias("files"),
        F.sum("bytes").cast("long").alias("bytes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("language", "bytes"))), lambda s: F.concat_ws("=", s["language"], s["bytes"].cast("string"))), ",").alias("languages"),
        F.max_by("language", main).alias("top_language"),
    )


def diff_sizes(diffs: DataFrame) -> DataFrame:
    """Added and removed lines and bytes of unified diffs (id, diff); binary diffs have none."""
    lines = diffs.where(~F.contains("diff", F.lit("Binary files"))).select("id", F.explode(F.split("diff", "\n")).alias("line"))
    lines = lines.where(~F.regexp_like("line", F.lit(r"^(\+\+\+|---|@@)")))
    added, removed = F.startswith("line", F.lit("+")), F.startswith("line", F.lit("-"))
    size = F.octet_length(F.substring("line", 2, 2**31 - 1))
    by = lines.groupBy("id").agg(F.count_if(added).alias("added_lines"), F.count_if(removed).alias("removed_lines"), F.coalesce(F.sum(F.when(added, size)), F.lit(0)).cast("long").alias("added_bytes"), F.coalesce(F.sum(F.when(removed, size)), F.lit(0)).cast("long").alias("removed_bytes"))
    out = diffs.select("id").join(by, "id", "left").fillna(0)
    return out.withColumn("sloc", C.bytes_to_sloc(F.col("added_bytes") + F.col("removed_bytes")))


AS_OF = "1998-06-01"
_commits, _changes = S.commits, S.file_changes


def _as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def _authored(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).join(_commits(spark, d).select("commit_sha", "author_email").dropDuplicates(["commit_sha"]), "commit_sha")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).groupBy("file_path").agg(F.sum("addition_bytes").cast("long").alias("bytes"))


def _status(spark: SparkSession, d: str) -> DataFrame:
    b = branch_metrics(_commits(spark, d)).withColumn("is_merged", F.col("unique_commits") % 7 == 0).withColumn("is_deleted", F.col("commits") % 5 == 0)
    return b.select("codebase_id", "branch_name", branch_status(b, _as_of()).alias("status"))


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("--- a\n+++ b\n@@ -1 +1 @@\n+"), F.regexp_replace("text", "\n", "\n-")).alias("diff"))


_PER = f"once AS (SELECT * EXCLUDE (branch_name) FROM (SELECT *, row_number() OVER (PARTITION BY codebase_id, commit_sha ORDER BY branch_name) AS rn FROM commits) WHERE rn = 1)"
_TOTALS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS total_{c}" for c in SUMS)
_WITH = f"WITH {S.COMMITS}, {_PER}"
_BRANCHES = f"""WITH {S.COMMITS}, x AS (SELECT c.*, m.commit_sha IS NOT NULL AS shared FROM commits c LEFT JOIN (SELECT DISTINCT codebase_id, commit_sha FROM commits WHERE branch_name = 'main') m ON m.codebase_id = c.codebase_id AND m.commit_sha = c.commit_sha),
b AS (SELECT codebase_id, branch_name, count(*) AS commits, count(*) FILTER (NOT shared) AS unique_commits, CAST(coalesce(sum(additions_lines) FILTER (NOT shared), 0) AS BIGINT) AS unique_additions, CAST(coalesce(sum(sloc) FILTER (NOT shared), 0) AS BIGINT) AS unique_sloc,
  arg_max(commit_sha, (committed_at, commit_sha)) AS head_sha, arg_max(commit_sha, (committed_at, commit_sha)) FILTER (shared) AS divergence_sha, arg_max(tree_bytes, (committed_at, commit_sha)) AS head_tree_bytes, arg_max(tree_bytes, (committed_at, commit_sha)) FILTER (shared) AS divergence_tree_bytes, max(committed_at) AS last_commit_at FROM x GROUP BY 1, 2)"""

QUERIES = {
    "a1_repository_summary": lambda s, d: repository_summary(_commits(s, d)),
    "a2_daily_rollup": lambda s, d: daily_rollup(_commits(s, d)),
    "a3_monthly_rollup": lambda s, d: monthly_rollup(_commits(s, d)),
    "a4_branch_metrics": lambda s, d: branch_metrics(_commits(s, d)),
    "a5_contributors": lambda s, d: contributors(_commits(s, d), _as_of()),
    "a6_directory_ownership": lambda s, d: directory_ownership(_changes(s, d), _commits(s, d)),
    "a7_file_ownership": lambda s, d: file_ownership(_authored(s, d)),
    "a8_primary_language": lambda s, d: primary_language(_changes(s, d)),
    "a9_directory_rollup": lambda s, d: directory_rollup(_files(s, d)),
    "a24_diff_sizes": lambda s, d: diff_sizes(_diffs(s, d)),
    "p15_branch_status": _status,
}
_DIR = "CASE WHEN len(string_split(file_path, '/')) <= 1 THEN 'root' WHEN len(string_split(file_path, '/')) = 2 THEN string_split(file_path, '/')[1] ELSE string_split(file_path, '/')[1] || '/' || string_split(file_path, '/')[2] END"
_LANG = "CASE WHEN file_path LIKE '%.py' THEN 'Python' WHEN file_path LIKE '%.java' THEN 'Java' WHEN file_path LIKE '%.go' THEN 'Go' WHEN file_path LIKE '%.rs' THEN 'Rust' WHEN file_path LIKE '%.md' THEN 'Markdown' END"
SQL = {
    "a1_repository_summary": f"""{_WITH} SELECT o.*, total_branches, coalesce(total_deletions_lines / nullif(total_additions_lines, 0), 0.0) AS churn_ratio, CAST(floor(tree_bytes / 50) AS BIGINT) AS tree_sloc FROM
(SELECT codebase_id, count(*) AS total_commits, count(DISTINCT author_email) AS total_contributors, {_TOTALS}, min(committed_at) AS first_commit_at, max(committed_at) AS last_commit_at, count(*) FILTER (is_merge_commit) AS merge_commits, count(*) FILTER (is_refactor) AS refactors, arg_max(tree_bytes, (committed_at, commit_sha)) AS tree_bytes, arg_max(commit_sha, (committed_at, commit_sha)) AS head_sha FROM once GROUP BY 1) o
JOIN (SELECT codebase_id, count(DISTINCT branch_name) AS total_branches FROM commits GROUP BY 1) b ON b.codebase_id = o.codebase_id""",
    "a2_daily_rollup": f"""{_WITH} SELECT *, CAST(sum(total_net_lines) OVER (PARTITION BY codebase_id ORDER BY day) AS BIGINT) AS cumulative_net_lines FROM (SELECT codebase_id, CAST(committed_at AS DATE) AS day, count(*) AS commits, count(DISTINCT author_email) AS contributors, {_TOTALS}, arg_max(tree_bytes, (committed_at, commit_sha)) AS tree_bytes FROM once GROUP BY 1, 2)""",
    "a3_monthly_rollup": f"""{_WITH} SELECT codebase_id, strftime(committed_at, '%Y-%m') AS month, count(*) AS commits, count(DISTINCT author_email) AS contributors, CAST(sum(additions_lines) AS BIGINT) AS additions, CAST(sum(net_bytes) AS BIGINT) AS net_sloc, max(tree_bytes) AS max_tree_bytes, avg(churn_lines) AS mean_churn FROM once GROUP BY 1, 2""",
    "a4_branch_metrics": f"{_BRANCHES} SELECT *, head_tree_bytes - coalesce(divergence_tree_bytes, 0) AS tree_delta FROM b",
    "a5_contributors": f"""WITH {S.COMMITS}, m AS (SELECT codebase_id, author_email, branch_name, row_number() OVER (PARTITION BY codebase_id, author_email ORDER BY count(*) DESC, branch_name) AS rn FROM commits GROUP BY 1, 2, 3)
SELECT c.codebase_id, c.author_email, count(*) AS total_commits, {', '.join(f"count(*) FILTER (committed_at >= TIMESTAMP '{AS_OF}' - INTERVAL {n} DAY) AS commits_{n}d" for n in (30, 90, 365))}, array_to_string(list_sort(list(DISTINCT c.branch_name)), ',') AS branches, any_value(m.branch_name) AS primary_branch, avg(sloc) AS mean_sloc, CAST(sum(sloc) AS BIGINT) AS total_sloc, min(committed_at) AS first_commit_at, max(committed_at) AS last_commit_at
FROM commits c JOIN m ON m.codebase_id = c.codebase_id AND m.author_email = c.author_email AND rn = 1 GROUP BY 1, 2""",
    "a6_directory_ownership": f"""{_WITH}, {S.CHANGES}, j AS (SELECT {_DIR} AS directory, author_email, CAST(floor(c.addition_bytes / 50) + floor(c.deletion_bytes / 50) AS BIGINT) AS churn, c.commit_sha, committed_at FROM changes c JOIN once o ON o.commit_sha = c.commit_sha),
g AS (SELECT directory, author_email, CAST(sum(churn) AS BIGINT) AS churn_sloc, count(DISTINCT commit_sha) AS commits, count(DISTINCT committed_at) AS active_days FROM j GROUP BY 1, 2)
SELECT * FROM (SELECT *, coalesce(churn_sloc * 100 / nullif(sum(churn_sloc) OVER (PARTITION BY directory), 0), 0.0) AS share, count(*) OVER (PARTITION BY directory) AS contributors, CAST(row_number() OVER (PARTITION BY directory ORDER BY churn_sloc DESC, author_email) AS INT) AS rank FROM g) WHERE rank <= 10""",
    "a7_file_ownership": f"""{_WITH}, {S.CHANGES}, g AS (SELECT file_path, author_email, CAST(sum(c.additions_lines - c.deletions_lines) AS BIGINT) AS net_lines FROM changes c JOIN once o ON o.commit_sha = c.commit_sha GROUP BY 1, 2)
SELECT *, CASE WHEN sum(abs(net_lines)) OVER (PARTITION BY file_path) = 0 THEN 100.0 / count(*) OVER (PARTITION BY file_path) ELSE abs(net_lines) * 100 / sum(abs(net_lines)) OVER (PARTITION BY file_path) END AS share FROM g""",
    "a8_primary_language": f"WITH {S.CHANGES} SELECT language, bytes FROM (SELECT {_LANG} AS language, CAST(sum(addition_bytes) AS BIGINT) AS bytes FROM changes GROUP BY 1) WHERE language IS NOT NULL ORDER BY bytes DESC, language DESC LIMIT 1",
    "a9_directory_rollup": f"""WITH {S.CHANGES}, f AS (SELECT file_path, CAST(sum(addition_bytes) AS BIGINT) AS bytes FROM changes GROUP BY 1), s AS (SELECT *, string_split(file_path, '/') AS p FROM f),
x AS (SELECT unnest(list_transform(range(len(p)), lambda i: array_to_string(p[1:i], '/'))) AS directory, coalesce({_LANG}, 'Unknown') AS language, bytes FROM s),
g AS (SELECT directory, language, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM x GROUP BY 1, 2)
SELECT directory, CAST(sum(files) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, string_agg(language || '=' || bytes, ',' ORDER BY language) AS languages, arg_max(language, (CASE WHEN language IN ('Markdown', 'Text', 'JSON', 'YAML') THEN 0 ELSE 1 END, bytes, language)) AS top_language FROM g GROUP BY 1""",
    "a24_diff_sizes": r"""WITH l AS (SELECT doc_id AS id, unnest(string_split('+' || replace(text, chr(10), chr(10) || '-'), chr(10))) AS line FROM documents WHERE text NOT LIKE '%Binary files%'),
k AS (SELECT * FROM l WHERE NOT regexp_matches(line, '^(\+\+\+|---|@@)')),
g AS (SELECT d.doc_id AS id, count(*) FILTER (line LIKE '+%') AS added_lines, count(*) FILTER (line LIKE '-%') AS removed_lines, CAST(coalesce(sum(strlen(substr(line, 2))) FILTER (line LIKE '+%'), 0) AS BIGINT) AS added_bytes, CAST(coalesce(sum(strlen(substr(line, 2))) FILTER (line LIKE '-%'), 0) AS BIGINT) AS removed_bytes FROM documents d LEFT JOIN k ON k.id = d.doc_id GROUP BY 1)
SELECT *, CAST(floor((added_bytes + removed_bytes) / 50) AS BIGINT) AS sloc FROM g""",
    "p15_branch_status": f"{_BRANCHES} SELECT codebase_id, branch_name, CASE WHEN unique_commits % 7 = 0 THEN 'merged' WHEN commits % 5 = 0 THEN 'deleted' WHEN branch_name = 'main' THEN 'default' WHEN last_commit_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 'stale' ELSE 'active' END AS status FROM b",
}
