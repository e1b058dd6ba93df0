"""Usage ledger: balances, summaries, sessions, log replay, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelark.functions import columns as C
from tidelark.operators.listing import latest_by
from tidelark.plans.standins import table


def balance(events: DataFrame, key: str = "organization_id") -> DataFrame:
    """Credits and debits in lines of code, and what is left; debits are stored negative."""
    credit = F.col("event_type") == "credit"
    sums = events.groupBy(key).agg(
        F.coalesce(F.sum(F.when(credit, F.col("bytes_in"))), F.lit(0)).cast("long").alias("credit_bytes"), F.coalesce(F.sum(F.when(~credit, F.col("bytes_in") + F.col("bytes_out"))), F.lit(0)).cast("long").alias("debit_bytes")
    )
    return sums.select(key, C.bytes_to_sloc("credit_bytes").alias("credits"), C.bytes_to_sloc("debit_bytes").alias("debits")).withColumn("balance", F.col("credits") - F.col("debits"))


def summary(events: DataFrame, types: list[str], key: str = "organization_id") -> DataFrame:
    """Events and lines by type, one column each, and the users who caused any."""
    aggs = [a for t in types for a in (F.count_if(F.col("event_type") == t).alias(f"n_{t}"), C.bytes_to_sloc(F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col("bytes_in") + F.col("bytes_out"))), F.lit(0))).alias(f"sloc_{t}"))]
    return events.groupBy(key).agg(*aggs, F.countDistinct("user_id").alias("seats"))


def histogram(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Runs of a user's events no further apart than the gap."""
    by, micros = Window.partitionBy("user_id").orderBy("ts", "event_id"), F.unix_micros(F.col("ts").cast("timestamp"))
    new = F.coalesce(micros - F.lag(micros).over(by) > gap_seconds * 1_000_000, F.lit(True))
    x = events.withColumn("session", F.sum(new.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


def transitions(states: DataFrame, key: str, state: str, *order: str) -> DataFrame:
    """Rows whose state differs from the one before it."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return states.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col(state)))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows by key; the higher version wins, the new row on ties (a late row never overwrites a newer one)."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_by(both, keys, version, "_new").drop("_new")


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing keys win."""
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti"))


def reconcile(existing: DataFrame, truth: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows to delete) by what the source of truth has."""
    t = truth.select(*keys).distinct()
    return existing.join(t, keys, "left_semi"), existing.join(t, keys, "left_anti")


def route(event_type: Column | str) -> Column:
    """What an identity event is handled as."""
    e = C.col(event_type)
    return F.when(e.isin("s", "ss"), "login").when(e == "sdu", "delete_user").when(F.contains(e, F.lit("organization_member")), "membership").when(e == "sapi", "api").otherwise("ignored")


def tombstones(previous: DataFrame, current: DataFrame, key: str = "branch") -> DataFrame:
    """Current branches and those that were there before: a deleted one keeps its last values until it appears again."""
    gone = previous.join(current.select(key), key, "left_anti").withColumn("is_deleted", F.lit(True))
    return current.withColumn("is_deleted", F.lit(False)).unionByName(gone.select(*current.columns, "is_deleted"))


def since(rows: DataFrame, column: str, mark) -> DataFrame:
    """Rows after a high-water mark; all without one."""
    return rows if mark is None else rows.where(F.col(column) > F.lit(mark))


def _ledger(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "credit").otherwise(F.col("event_type"))
    size = F.floor(F.abs("value") * 1000).cast("long")
    return e.select("event_id", "ts", "user_id", (F.col("user_id") % 10).alias("organization_id"), kind.alias("event_type"), F.when(kind == "credit", size * 20).otherwise(-size).alias("bytes_in"), F.when(kind == "credit", 0).otherwise(-F.floor(size / 2)).cast("long").alias("bytes_out"))


_LEDGER = "l AS (SELECT event_id, ts, user_id, user_id % 10 AS organization_id, CASE event_type WHEN 'purchase' THEN 'credit' ELSE event_type END AS event_type, CASE event_type WHEN 'purchase' THEN z * 20 ELSE -z END AS bytes_in, CASE event_type WHEN 'purchase' THEN 0 ELSE -(z // 2) END AS bytes_out FROM (SELECT *, CAST(floor(abs(value) * 1000) AS BIGINT) AS z FROM events))"
_TYPES = ["view", "click", "credit"]


def _versions(s: SparkSession, d: str, low: int, high: int) -> DataFrame:
    return table(s, d, "orders").where(f"o_orderkey % 10 BETWEEN {low} AND {high}").select("o_custkey", "o_orderkey", "o_totalprice")


def _one(df: DataFrame) -> DataFrame:
    return latest_by(df, ["o_custkey"], "o_orderkey")


_V = "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 BETWEEN {} AND {} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1"
_AB = f"WITH a AS ({_V.format(0, 5)}), b AS ({_V.format(4, 9)})"
QUERIES = {
    "a10_org_totals": lambda s, d: _ledger(s, d).groupBy("organization_id").agg(F.count("*").alias("n"), F.sum("bytes_in").cast("long").alias("bytes_in")),
    "a11_filtered_summary": lambda s, d: table(s, d, "orders").join(table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("complete")),
    "a12_usage_balance": lambda s, d: balance(_ledger(s, d)),
    "a13_usage_summary": lambda s, d: summary(_ledger(s, d), _TYPES),
    "a20_monthly_text": lambda s, d: table(s, d, "orders").groupBy("o_custkey", C.month("o_orderdate").alias("month")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), "\n").alias("log")),
    "a21_histogram": lambda s, d: histogram(table(s, d, "events")),
    "a22_statistics": lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).agg(F.count("*").alias("total"), F.avg("n").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("n") == 1).alias("single")),
    "s13_upsert": lambda s, d: upsert(_one(_versions(s, d, 0, 5)), _one(_versions(s, d, 4, 9)), ["o_custkey"], "o_orderkey"),
    "s14_insert_ignore": lambda s, d: insert_ignore(_one(_versions(s, d, 0, 5)), _one(_versions(s, d, 4, 9)), ["o_custkey"]),
    "s16_delete_by_key": lambda s, d: _one(_versions(s, d, 0, 9)).where("o_custkey <> 1"),
    "s17_sql_with_parameters": lambda s, d: s.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": 200000, "status": "F"}, orders=table(s, d, "orders")),
    "st4_since_mark": lambda s, d: since(table(s, d, "events"), "event_id", 500).select("event_id"),
    "st5_tombstones": lambda s, d: tombstones(_one(_versions(s, d, 0, 5)), _one(_versions(s, d, 4, 9)), "o_custkey"),
    "st7_dispatch": lambda s, d: table(s, d, "events").select("event_id", route(F.element_at(F.array(*map(F.lit, ["s", "ss", "sdu", "add_organization_member", "sapi", "fp"])), (F.col("event_id") % 6 + 1).cast("int"))).alias("handler")),
    "st8_last_writer_wins": lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.event_type", "x.value"),
    "st10_reconcile": lambda s, d: reconcile(_one(_versions(s, d, 0, 5)), _one(_versions(s, d, 4, 9)), ["o_custkey"])[1],
    "st11_sessions": lambda s, d: sessions(table(s, d, "events")),
    "st13_transitions": lambda s, d: transitions(table(s, d, "events"), "user_id", "event_type", "ts", "event_id").select("event_id", "before", "event_type"),
}
SQL = {
    "a10_org_totals": f"WITH {_LEDGER} SELECT organization_id, count(*) AS n, CAST(sum(bytes_in) AS BIGINT) AS bytes_in FROM l GROUP BY 1",
    "a11_filtered_summary": "SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS complete FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "a12_usage_balance": f"WITH {_LEDGER}, g AS (SELECT organization_id, CAST(floor(abs(coalesce(sum(bytes_in) FILTER (event_type = 'credit'), 0)) / 50) AS BIGINT) AS credits, CAST(floor(abs(coalesce(sum(bytes_in + bytes_out) FILTER (event_type <> 'credit'), 0)) / 50) AS BIGINT) AS debits FROM l GROUP BY 1) SELECT *, credits - debits AS balance FROM g",
    "a13_usage_summary": f"WITH {_LEDGER} SELECT organization_id, {', '.join(f"count(*) FILTER (event_type = '{t}') AS n_{t}, CAST(floor(abs(coalesce(sum(bytes_in + bytes_out) FILTER (event_type = '{t}'), 0)) / 50) AS BIGINT) AS sloc_{t}" for t in _TYPES)}, count(DISTINCT user_id) AS seats FROM l GROUP BY 1",
    "a20_monthly_text": "SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS month, string_agg(o_orderkey, chr(10) ORDER BY o_orderdate, o_orderkey) AS log FROM orders GROUP BY 1, 2",
    "a21_histogram": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "a22_statistics": "SELECT count(*) AS total, avg(n) AS mean, min(n) AS least, max(n) AS most, count(*) FILTER (n = 1) AS single FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)",
    "s13_upsert": f"{_AB} SELECT * FROM (SELECT * FROM a UNION SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
    "s14_insert_ignore": f"{_AB} SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)",
    "s16_delete_by_key": f"SELECT * FROM ({_V.format(0, 9)}) WHERE o_custkey <> 1",
    "s17_sql_with_parameters": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'",
    "st4_since_mark": "SELECT event_id FROM events WHERE event_id > 500",
    "st5_tombstones": f"{_AB} SELECT *, FALSE AS is_deleted FROM b UNION ALL SELECT *, TRUE FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b)",
    "st7_dispatch": "SELECT event_id, ['login', 'login', 'delete_user', 'membership', 'api', 'ignored'][event_id % 6 + 1] AS handler FROM events",
    "st8_last_writer_wins": "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "st10_reconcile": f"{_AB} SELECT * FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b)",
    "st11_sessions": "WITH x AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 1800000000, TRUE) AS new FROM events), y AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM x) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, min(ts) AS started_at, max(ts) AS ended_at, arg_max(event_type, (ts, event_id)) AS status FROM y GROUP BY 1, 2",
    "st13_transitions": "SELECT event_id, before, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type",
}
