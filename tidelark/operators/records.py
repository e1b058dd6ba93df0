"""Queries of the functions on single records: scores in JSON, hashes, rounding, scaling, time zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelark.functions import columns as C
from tidelark.plans.standins import table

_SCORES = ("api", "cli", "lib", "web")


def _records(s: SparkSession, d: str) -> DataFrame:
    """Parts with scores of four kinds in JSON, a changelog by month and a file name."""
    k, size = F.col("p_partkey"), F.col("p_size")
    scores = F.to_json(F.struct(*[((k * (i + 2) + size) % (5 + i)).alias(n) for i, n in enumerate(_SCORES)]))
    log = F.to_json(F.create_map(F.concat(F.lit("2024-"), F.lpad((k % 12 + 1).cast("string"), 2, "0")), F.col("p_name")))
    extension = F.element_at(F.array(*map(F.lit, [".go", ".h++", ".S", ".rbi", ".tsx", ".md", ""])), (k % 7 + 1).cast("int"))
    return table(s, d, "part").select(k, scores.alias("scores"), log.alias("log"), F.concat(F.lit("src/p"), k.cast("string"), extension).alias("path"), F.lpad((size % 12 + 1).cast("string"), 2, "0").alias("month"))


def _keys(s: SparkSession, d: str) -> DataFrame:
    month = F.concat(F.lit("2024-"), F.col("month"))
    return _records(s, d).select(
        "p_partkey", F.array_join(C.ordered_keys("scores"), ",").alias("kinds"), C.json_or("log", month, "none this month").alias("changes"),
        C.symbol_language("path").alias("language"), C.content_hash("path").alias("hash"), C.config_hash("log").alias("config"),
    )


def _stable_ids(s: SparkSession, d: str) -> DataFrame:
    """Each order as a task that needs the tasks of its lines, by line number and part."""
    lines = table(s, d, "lineitem").select("l_orderkey", C.stable_id(F.lit("Line"), F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")), F.array().cast("array<string>")).alias("id"))
    needs = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("id")).alias("needs"))
    x = table(s, d, "orders").join(needs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    x = x.withColumn("needs", F.coalesce("needs", F.array().cast("array<string>")))
    return x.select("o_orderkey", C.content_hash(C.stable_id(F.lit("Order"), F.col("o_orderkey").cast("string"), "needs")).alias("task_hash"))


def _numbers(s: SparkSession, d: str) -> DataFrame:
    price, count = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    key = F.col("l_orderkey")
    time = F.concat(F.lit("2024-01-05T10:00:00"), F.element_at(F.array(*map(F.lit, ["Z", "+02:00", "", ".5-0330"])), (key % 4 + 1).cast("int")))
    return table(s, d, "lineitem").select(
        key, "l_linenumber", "l_partkey", C.round_half_even(price / count).alias("unit_price"), C.round_half_even(count / 8.0).alias("eighths"), C.round_half_even(count * 0.005).alias("halves"),
        C.scale_factor(key, F.col("l_partkey"), 1000, 10).alias("files_as_one"), C.zone_error(time, "start_date").alias("error"),
    )


_PARTS = "p AS (SELECT p_partkey AS k, p_size AS z, p_name, 'src/p' || p_partkey || ['.go', '.h++', '.S', '.rbi', '.tsx', '.md', ''][p_partkey % 7 + 1] AS path FROM part)"
QUERIES = {"f_keys": _keys, "x10_stable_ids": _stable_ids, "f_numbers": _numbers}
SQL = {
    "f_keys": f"""WITH {_PARTS} SELECT k AS p_partkey, array_to_string(list_transform(list_sort([{{'s': -((k * 2 + z) % 5), 'n': 'api'}}, {{'s': -((k * 3 + z) % 6), 'n': 'cli'}}, {{'s': -((k * 4 + z) % 7), 'n': 'lib'}}, {{'s': -((k * 5 + z) % 8), 'n': 'web'}}])[1:3], lambda x: x.n), ',') AS kinds,
CASE WHEN k % 12 = z % 12 THEN p_name ELSE 'none this month' END AS changes, ['GO', 'C_OR_CPP_HEADER', 'ASSEMBLY', 'RUBY', 'TYPESCRIPT', 'DEFAULT', 'DEFAULT'][k % 7 + 1] AS language, sha256(path) AS hash, left(sha256('{{"2024-' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '":"' || p_name || '"}}'), 16) AS config FROM p""",
    "x10_stable_ids": "WITH l AS (SELECT l_orderkey, 'Line_' || l_linenumber || '.' || l_partkey || '.' || l_suppkey AS id FROM lineitem), n AS (SELECT l_orderkey, string_agg(id, '_' ORDER BY id) AS ids FROM l GROUP BY 1) SELECT o_orderkey, sha256('Order_' || o_orderkey || coalesce('_' || ids, '')) AS task_hash FROM orders LEFT JOIN n ON l_orderkey = o_orderkey",
    # Printing rounds the exact binary value; true ties go to the even digit.
    "f_numbers": """WITH x AS (SELECT *, CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_quantity AS DOUBLE) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(printf('%.2f', price / n) AS DOUBLE) AS unit_price, CAST(printf('%.2f', n / 8.0::DOUBLE) AS DOUBLE) AS eighths, CAST(printf('%.2f', n * 0.005::DOUBLE) AS DOUBLE) AS halves,
CAST(CASE WHEN l_orderkey + l_partkey > 1000 AND l_orderkey > 1000 AND l_partkey // 10 < 1000 THEN ceil(l_orderkey / (1000 - l_partkey // 10)) ELSE 1 END AS BIGINT) AS files_as_one,
CASE WHEN l_orderkey % 4 = 2 THEN 'start_date must name its time zone' END AS error FROM x""",
}
