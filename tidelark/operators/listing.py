"""Filters, sorts and pages from request parameters, and the ranking and set operators that listings use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelark.functions import columns as C
from tidelark.plans.standins import table

#: Comparison by the name that follows two underscores.
COMPARISONS = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "in": lambda c, v: c.isin(v.split(",") if isinstance(v, str) else list(v)),
    "nin": lambda c, v: ~c.isin(v.split(",") if isinstance(v, str) else list(v)),
    "lt": lambda c, v: c < v,
    "gt": lambda c, v: c > v,
    "lte": lambda c, v: c <= v,
    "gte": lambda c, v: c >= v,
    "like": lambda c, v: c.like(v),
    "ilike": lambda c, v: c.ilike(v),
}
MAX_PAGE = 100


def predicate(df: DataFrame, key: str, value, json_columns: tuple[str, ...] = ()) -> Column | None:
    """field__op=value as a Column; None for a plain field that the table doesn't have.

    A value with a comma and no operator means one of several.  A dotted field is a path into a JSON column.
    """
    field, _, op = key.partition("__")
    if op and op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op}")
    if not op:
        op = "in" if isinstance(value, str) and "," in value else "eq"
    head, _, path = field.partition(".")
    if path and head in json_columns:
        return COMPARISONS[op](C.json_path(head, path), value)
    return COMPARISONS[op](F.col(field), value) if field in df.columns else None


def where_all(df: DataFrame, filters: dict, json_columns: tuple[str, ...] = ()) -> DataFrame:
    found = [p for k, v in filters.items() if (p := predicate(df, k, v, json_columns)) is not None]
    return df.where(reduce(lambda a, b: a & b, found)) if found else df


def where_related(df: DataFrame, related: DataFrame, on: str, filters: dict) -> DataFrame:
    """Rows with a related row that passes the filters."""
    return df.join(where_all(related, filters).select(on), on, "left_semi")


def where_tuples(df: DataFrame, filters: list[tuple[str, str, object]]) -> DataFrame:
    """Conjunction of (column, operator, value)."""
    names = {"==": "eq", "=": "eq", "!=": "neq", "<": "lt", ">": "gt", "<=": "lte", ">=": "gte", "in": "in", "not in": "nin"}
    return where_all(df, {f"{c}__{names[o]}": v for c, o, v in filters}) if len({(c, o) for c, o, _ in filters}) == len(filters) else reduce(lambda d, f: where_tuples(d, [f]), filters, df)


def search_any(df: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Case-insensitive substring in any of the columns."""
    return df.where(reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(needle.lower())) for c in columns]))


def page(df: DataFrame, sort: str, key: str, descending: bool = False, limit: int = MAX_PAGE, offset: int = 0) -> DataFrame:
    """A page in the order of `sort`, nulls last when descending, ties by key."""
    if not 0 < limit <= MAX_PAGE:
        raise ValueError(f"limit must be from 1 to {MAX_PAGE}")
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return df.orderBy(order, F.asc(key)).offset(offset).limit(limit)


def page_info(df: DataFrame, cursor: int, limit: int) -> tuple[int | None, int]:
    """(next cursor, rows after this page)."""
    left = max(0, df.count() - cursor - limit)
    return (cursor + limit if left else None), left


def first_by(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark limits each partition before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def latest_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return first_by(df, keys, *[F.desc_nulls_last(c) for c in order])


def first_source_wins(key: str, *sources: DataFrame) -> DataFrame:
    """Union by key; a row of an earlier source hides those of later ones."""
    tagged = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    return first_by(reduce(DataFrame.unionByName, tagged), [key], F.asc("_source")).drop("_source")


def difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b.select(*on), on, "left_anti")


def map_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def buckets_of(df: DataFrame, group: str, order: str, text: str, size: int) -> DataFrame:
    """Every `size` rows of a group in order, their texts joined."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    x = df.withColumn("bucket", F.floor((n - 1) / size).cast("long"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), "|")
    return x.groupBy(group, "bucket").agg(joined.alias("joined"))


def until_budget(df: DataFrame, group: list[str], order: str, size: str, budget: int) -> DataFrame:
    """Rows in order as long as the sizes before them are below the budget."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("before", before.cast("long")).where(F.col("before") < budget)


def update_due(last: Column, policy: Column, as_of: Column) -> Column:
    """Whether the policy's time has passed since the last update; no update yet is due, no policy is never due."""
    seconds = {"hourly": 3600, "daily": 86400, "weekly": 604800, "monthly": 2592000}
    wait = F.try_element_at(F.create_map(*(F.lit(x) for kv in seconds.items() for x in kv)), policy)
    return F.when(wait.isNull(), False).otherwise(last.isNull() | (F.unix_timestamp(as_of) - F.unix_timestamp(last) >= wait))


def _orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders")


def _files(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    ext = F.element_at(F.array(*map(F.lit, [".py", ".svg", "", ".tar.gz", ".", ".BIN"])), (F.col("p_size") % 6 + 1).cast("int"))
    top = F.element_at(F.array(*map(F.lit, ["src/", ".git/", "", "a/generated_docs/", ".", "a/b/c/"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select("p_partkey", "p_name", F.concat(top, F.translate("p_name", " ", "_"), ext).alias("path"))


def _paths(s: SparkSession, d: str) -> DataFrame:
    f = _files(s, d)
    return f.select(
        "path", C.directory_of("path").alias("directory"), C.suffix("path").alias("suffix"), C.naive_extension("path").alias("naive"), C.depth("path").alias("depth"), C.parent("path").alias("parent"), C.with_slash(C.parent("path")).alias("slashed"),
        C.is_analyzable("path", ("generated_docs",)).alias("analyzable"), C.language_of("path").alias("language"), C.file_name("path").alias("name"), F.size(C.ancestors("path")).alias("n_ancestors"), C.qualified_name(C.parent("path"), F.lit("::"), C.file_name("path")).alias("qualified"), C.spaced(C.file_name("path")).alias("spaced"),
    )


def _texts(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents")
    return t.select("doc_id", C.line_count("text").alias("lines"), F.octet_length("text").alias("bytes"), F.left("text", F.lit(1000)).alias("head"), C.is_hex("text").alias("hex_text"), C.is_hex(F.md5("text")).alias("hex_digest"), C.org_bucket("source").alias("bucket"), F.left(F.sha2("text", 256), F.lit(8)).alias("short_sha"), C.line_window("text", F.lit(2), F.lit(3)).alias("window"), C.looks_binary("text").alias("binary"))


def _dates(s: SparkSession, d: str) -> DataFrame:
    o, as_of = _orders(s, d), F.to_timestamp(F.lit("1998-06-01"))
    policy = F.element_at(F.array(*map(F.lit, ["hourly", "daily", "weekly", "monthly", "never"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select("o_orderkey", F.to_date("o_orderdate").alias("day"), C.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month_no"), F.dayofmonth("o_orderdate").alias("day_no"), C.within_days("o_orderdate", as_of, 90).alias("recent"), (F.unix_timestamp(as_of) - F.unix_timestamp("o_orderdate")).alias("elapsed"), update_due(F.col("o_orderdate"), policy, as_of).alias("due"))


def _scores(s: SparkSession, d: str) -> DataFrame:
    o = _orders(s, d).select("o_orderkey", (F.col("o_totalprice") / 250000).alias("x"))
    return o.select("o_orderkey", C.semantic_score("x").alias("semantic"), C.keyword_score("x").alias("keyword"), C.weighted_mean((C.semantic_score("x"), 2.0), (F.when(F.col("o_orderkey") % 2 == 0, C.keyword_score("x")), 1.0)).alias("mean"), C.safe_ratio("x", F.col("o_orderkey") % 3).alias("ratio"), C.clamp(F.col("x") - 1).alias("clamped"), C.bytes_to_sloc(F.lit(0) - F.col("o_orderkey")).alias("sloc"), C.size_category(F.col("o_orderkey") % 300).alias("category"))


_JSON = "event_id, ts, user_id, event_type, value, props"
_EXT = "['.py', '.svg', '', '.tar.gz', '.', '.BIN'][p_size % 6 + 1]"
_TOP = "['src/', '.git/', '', 'a/generated_docs/', '.', 'a/b/c/'][p_partkey % 6 + 1]"
QUERIES = {
    "p2_conjunction": lambda s, d: where_tuples(_orders(s, d), [("o_orderstatus", "in", ["F", "O"]), ("o_totalprice", ">=", 100000.0), ("o_totalprice", "<", 200000.0)]).select("o_orderkey", "o_orderstatus", "o_totalprice"),
    "p3_predicate_grammar": lambda s, d: where_all(_orders(s, d), {"o_orderstatus": "F,O", "o_orderpriority__nin": "5-LOW", "o_totalprice__gt": 50000.0, "o_orderpriority__ilike": "%high%", "no_such_column": "x", "o_orderkey__neq": 7}).select("o_orderkey", "o_orderpriority"),
    "p4_related_predicate": lambda s, d: where_related(table(s, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), _orders(s, d), "o_custkey", {"o_totalprice__gt": 300000.0}).select("o_custkey", "c_name"),
    "p5_json_predicate": lambda s, d: where_all(table(s, d, "events"), {"props.k__eq": "7"}, ("props",)).select("event_id", "event_type"),
    "p6_search_any": lambda s, d: search_any(table(s, d, "part"), ["p_name", "p_type"], "AL").select("p_partkey"),
    "p8_time_range": lambda s, d: table(s, d, "events").where(F.col("ts").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))).select("event_id"),
    "p9_path_subtree": lambda s, d: _files(s, d).where(F.startswith("path", F.lit("a/"))).select("path", "p_partkey"),
    "p10_depth_bound": lambda s, d: _files(s, d).where(F.startswith("path", F.lit("a/")) & (C.depth("path") <= 3)).select("p_partkey"),
    "p18_json_key": lambda s, d: table(s, d, "events").where(C.json_has_key("props", "k") & F.lower("event_type").isin("click", "view")).select("event_id", C.json_path("props", "k").cast("int").alias("k")),
    "f_paths": _paths,
    "f_texts": _texts,
    "f_dates": _dates,
    "f_scores": _scores,
    "k1_page": lambda s, d: page(_orders(s, d), "o_totalprice", "o_orderkey", True, 50, 20).select("o_orderkey", "o_totalprice"),
    "k3_sort_by_related": lambda s, d: page(_orders(s, d).join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey", "left"), "c_acctbal", "o_orderkey", False, 60).select("o_orderkey", "c_acctbal"),
    "k4_last_days": lambda s, d: _orders(s, d).groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(365),
    "k9_token_budget": lambda s, d: until_budget(table(s, d, "documents"), ["source"], "doc_id", "n_chars", 20000).select("doc_id", "source", "before"),
    "w2_top_role": lambda s, d: first_by(_orders(s, d), ["o_custkey"], F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderstatus"),
    "w3_latest_version": lambda s, d: latest_by(_orders(s, d), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderdate"),
    "w4_three_key_rank": lambda s, d: first_by(_orders(s, d), ["o_custkey"], F.asc("o_orderpriority"), F.desc("o_orderstatus"), F.asc_nulls_last("o_orderdate"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey"),
    "w6_version_names": lambda s, d: _orders(s, d).withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).select("o_orderkey", F.concat(F.lit("0.0."), F.col("n").cast("string")).alias("version")),
    "w7_double_dedup": lambda s, d: first_by(first_by(_orders(s, d), ["o_custkey", "o_orderstatus"], F.desc("o_orderkey")), ["o_custkey"], F.asc("o_orderdate"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey"),
    "w10_top_in_group": lambda s, d: first_by(_orders(s, d), ["o_orderpriority"], F.desc("o_totalprice"), F.asc("o_orderkey"), n=10).select("o_orderpriority", "o_orderkey"),
    "w12_buckets": lambda s, d: buckets_of(_orders(s, d).select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey", "o_orderstatus", 4),
    "u2_union_distinct": lambda s, d: _orders(s, d).select(F.col("o_custkey").alias("k")).unionByName(table(s, d, "customer").select(F.col("c_custkey").alias("k"))).distinct(),
    "u3_except": lambda s, d: difference(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey")), _orders(s, d).where("o_orderpriority = '1-URGENT'"), ["o_custkey"]),
    "u4_intersect": lambda s, d: _orders(s, d).select(F.col("o_custkey").alias("k")).intersect(table(s, d, "supplier").select(F.col("s_suppkey").alias("k"))),
    "u5_first_source_wins": lambda s, d: first_source_wins("k", table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), table(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))),
    "u8_map_report": lambda s, d: map_report(table(s, d, "customer").select(F.col("c_nationkey").alias("k")), table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))).groupBy("k", "side").agg(F.count("*").alias("n")),
}
SQL = {
    "p2_conjunction": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 100000 AND o_totalprice < 200000",
    "p3_predicate_grammar": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('5-LOW') AND o_totalprice > 50000 AND o_orderpriority ILIKE '%high%' AND o_orderkey <> 7",
    "p4_related_predicate": "SELECT c_custkey AS o_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "p5_json_predicate": "SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k') = '7'",
    "p6_search_any": "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'al') OR contains(lower(p_type), 'al')",
    "p8_time_range": "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'",
    "p9_path_subtree": f"SELECT p_partkey, path FROM (SELECT p_partkey, {_TOP} || translate(p_name, ' ', '_') || {_EXT} AS path FROM part) WHERE starts_with(path, 'a/')",
    "p10_depth_bound": f"SELECT p_partkey FROM (SELECT p_partkey, {_TOP} || translate(p_name, ' ', '_') || {_EXT} AS path FROM part) WHERE starts_with(path, 'a/') AND len(string_split(path, '/')) <= 3",
    "p18_json_key": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE list_contains(json_keys(props), 'k') AND lower(event_type) IN ('click', 'view')",
    "f_paths": f"""WITH f AS (SELECT {_TOP} || translate(p_name, ' ', '_') || {_EXT} AS path FROM part), s AS (SELECT path, string_split(path, '/') AS p FROM f), n AS (SELECT *, p[-1] AS name, array_to_string(p[1:-2], '/') AS parent FROM s),
x AS (SELECT *, regexp_extract(name, '^\\.*[^.].*?(\\.[^.]+)$', 1) AS suffix FROM n)
SELECT path, CASE WHEN len(p) <= 1 THEN 'root' WHEN len(p) = 2 THEN p[1] ELSE p[1] || '/' || p[2] END AS directory, suffix, CASE WHEN contains(path, '.') THEN '.' || string_split(path, '.')[-1] END AS naive, CAST(len(p) AS INT) AS depth, parent, CASE WHEN parent = '' THEN '' ELSE parent || '/' END AS slashed,
NOT list_has_any(p, ['.git', 'generated_docs']) AND suffix NOT IN ('.svg', '.BIN') AS analyzable, CASE suffix WHEN '.py' THEN 'Python' END AS language, name, CAST(len(p) AS INT) AS n_ancestors, CASE WHEN parent = '' THEN name ELSE parent || '::' || name END AS qualified, replace(name, '_', ' ') AS spaced FROM x""",
    "f_texts": r"""SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS lines, CAST(strlen(text) AS INT) AS bytes, substr(text, 1, 1000) AS head, length(regexp_replace(text, '[^a-fA-F0-9\n ]', '', 'g')) / length(text) > 0.99 AS hex_text, TRUE AS hex_digest, substr(sha256(source), 1, 63) AS bucket, substr(sha256(text), 1, 8) AS short_sha, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS window, FALSE AS binary FROM documents""",
    "f_dates": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y-%m') AS month, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month_no, CAST(day(o_orderdate) AS INT) AS day_no, o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 90 DAY AS recent, CAST(epoch(TIMESTAMP '1998-06-01') - epoch(o_orderdate) AS BIGINT) AS elapsed, coalesce(epoch(TIMESTAMP '1998-06-01') - epoch(o_orderdate) >= [3600, 86400, 604800, 2592000, NULL][o_orderkey % 5 + 1], FALSE) AS due FROM orders",
    "f_scores": """WITH x AS (SELECT o_orderkey, o_totalprice / 250000 AS x FROM orders), y AS (SELECT *, greatest(0.0::DOUBLE, (1 - abs(1 - x)) * (1 - abs(1 - x)) * (1 - abs(1 - x))) AS semantic, greatest(0.0::DOUBLE, 1 - 1 / (1 + x)) AS keyword FROM x)
SELECT o_orderkey, semantic, keyword, CASE WHEN o_orderkey % 2 = 0 THEN (semantic * 2 + keyword) / 3 ELSE semantic END AS mean, coalesce(x / nullif(o_orderkey % 3, 0), 0.0) AS ratio, greatest(x - 1, 0.0::DOUBLE) AS clamped, CAST(floor(o_orderkey / 50) AS BIGINT) AS sloc, CASE WHEN o_orderkey % 300 < 10 THEN 'tiny' WHEN o_orderkey % 300 < 50 THEN 'small' WHEN o_orderkey % 300 < 200 THEN 'medium' ELSE 'large' END AS category FROM y""",
    "k1_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 20",
    "k3_sort_by_related": "SELECT o_orderkey, c_acctbal FROM orders LEFT JOIN customer ON c_custkey = o_custkey ORDER BY c_acctbal NULLS LAST, o_orderkey LIMIT 60",
    "k4_last_days": "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1 ORDER BY day DESC LIMIT 365",
    "k9_token_budget": "SELECT * FROM (SELECT doc_id, source, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM documents) WHERE before < 20000",
    "w2_top_role": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey DESC) = 1",
    "w3_latest_version": "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "w4_three_key_rank": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus DESC, o_orderdate NULLS LAST, o_orderkey) = 1",
    "w6_version_names": "SELECT o_orderkey, '0.0.' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders",
    "w7_double_dedup": "SELECT o_custkey, o_orderkey FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) = 1) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
    "w10_top_in_group": "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 10",
    "w12_buckets": "SELECT o_custkey, bucket, string_agg(o_orderstatus, '|' ORDER BY o_orderkey) AS joined FROM (SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS bucket FROM orders) GROUP BY 1, 2",
    "u2_union_distinct": "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer",
    "u3_except": "SELECT c_custkey AS o_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "u4_intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT s_suppkey FROM supplier",
    "u5_first_source_wins": "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)",
    "u8_map_report": "SELECT k, 'left' AS side, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) GROUP BY 1 UNION ALL SELECT k, 'right', count(*) FROM (SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer) GROUP BY 1",
}
