"""Line dedup by site-relative frequency.

A line's frequency on a host is the number of the host's pages that hold it divided by the host's pages.  Lines above
`max_ratio` are boilerplate of that host and are dropped from its pages; they stay on hosts where they are rare.

Only 16-byte digests of the lines are shuffled, counted once for a page and pre-aggregated before the shuffle.  A host can
have no more boilerplate lines than its mean lines a page divided by the ratio.  If all hosts' digests together are few
(checked), they are broadcast as one array for each host and texts are never shuffled; else the digests are joined to the
pages' lines by (host, digest) and the drops brought back by a hash of doc_id, or of the text where that is null.

Defined cases: a null text stays null; pages with a null host are left as they are, and the query and the stage take a null source
for the empty one; blank lines are never counted or dropped; lines are
compared without surrounding spaces, tabs and carriage returns; a line is boilerplate on `min_count` pages or more, whatever the
host's size, so that hosts of one or two pages keep theirs; a page that loses all its lines keeps an empty text; repeated rows of a doc_id count as pages of their own; other
columns pass through in the stage, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.llm.shared import cut, documents

MAX_RATIO, MIN_COUNT = 0.05, 3
#: Boilerplate digests of all hosts that are broadcast at most: 200,000 of 16 bytes.
BROADCAST_LINES = 200_000
#: What is trimmed off lines.
_BLANKS = " \t\r"


def _digests(text: Column) -> Column:
    """Digests of the lines of a text that are not blank."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(_BLANKS)))
    return F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.unhex(F.md5(x)))


def boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_count: int = MIN_COUNT) -> DataFrame:
    """host, digest, n_pages, ratio of the lines of (host, text) above the ratio."""
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    counts = pages.select("host", F.explode(F.array_distinct(_digests(F.col("text")))).alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_count)
    return counts.join(totals, "host").withColumn("ratio", F.col("n_pages") / F.col("host_pages")).where(F.col("ratio") > max_ratio).select("host", "digest", "n_pages", "ratio")


def clean_lines(pages: DataFrame, max_ratio: float = MAX_RATIO, min_count: int = MIN_COUNT, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """pages (doc_id, host, text, ...) with text without boilerplate lines, and n_lines and n_dropped added."""
    found = cut(boilerplate(pages, max_ratio, min_count).select("host", "digest"), "boilerplate")
    if found.count() <= broadcast_lines:
        drops = F.broadcast(found.groupBy("host").agg(F.collect_set("digest").alias("_drops")))
        with_drops = pages.join(drops.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left").drop("_host")
    else:
        # Pages are brought together by a hash that is never null; pages that share one only get more of their own host's digests.
        named = pages.withColumn("_page", F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))))
        lines = named.select("_page", "host", F.explode(F.array_distinct(_digests(F.col("text")))).alias("digest"))
        drops = lines.join(found, ["host", "digest"]).groupBy("_page", "host").agg(F.collect_set("digest").alias("_drops"))
        drops = drops.select(F.col("_page").alias("_id"), F.col("host").alias("_host"), "_drops")
        with_drops = named.join(drops, (F.col("_page") == F.col("_id")) & (F.col("host") == F.col("_host")), "left").drop("_page", "_id", "_host")
    line = F.split("text", "\n", -1)
    kept = F.filter(line, lambda x: ~F.array_contains("_drops", F.unhex(F.md5(F.trim(x, F.lit(_BLANKS))))))
    out = with_drops.withColumn("n_lines", F.coalesce(F.size(line), F.lit(0)).cast("long")).withColumn("_kept", F.when(F.col("_drops").isNull(), line).otherwise(kept))
    out = out.withColumn("n_dropped", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("_kept")).cast("long"))
    return out.withColumn("text", F.array_join("_kept", "\n")).drop("_kept", "_drops")


def _by_source(docs: DataFrame) -> DataFrame:
    return docs.withColumn("host", F.coalesce(F.col("source"), F.lit("")))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts lose their source's boilerplate lines; n_chars follows."""
    pages = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", F.coalesce("source", F.lit("")).alias("host"), "text")
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return clean_lines(pages).select(*(own.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(_by_source(documents(spark, sf_dir).select("doc_id", "source", "text"))).select("doc_id", "host", "n_lines", "n_dropped", "text")


QUERIES = {"op1_line_dedup": op1_line_dedup}
SQL = {
    "op1_line_dedup": """
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT DISTINCT doc_id, host, trim(unnest(ls), ' ' || chr(9) || chr(13)) AS line FROM d),
h AS (SELECT host, count(*) AS host_pages FROM d GROUP BY host),
b AS (SELECT u.host, list(line) AS drops FROM (SELECT host, line, count(*) AS c FROM u WHERE line <> '' GROUP BY host, line) u JOIN h ON h.host = u.host WHERE c >= 3 AND c / host_pages > 0.05 GROUP BY u.host),
k AS (SELECT d.doc_id, d.host, d.text, ls, list_filter(ls, lambda x: NOT list_contains(coalesce(drops, []), trim(x, ' ' || chr(9) || chr(13)))) AS kept FROM d LEFT JOIN b ON b.host = d.host)
SELECT doc_id, host, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text FROM k
"""
}
