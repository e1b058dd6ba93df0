"""Usage events as streams: append, out-of-order updates, deduplication, windows, sessions, throttling, checkpoints.

The functions take streaming or batch DataFrames alike; queries run them over a file stream to its end (availableNow), so the
same state, watermarks and checkpoints are used as in a run without end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidelark.operators.usage import route, upsert
from tidelark.sources.stores import KeyedStore, cut, new_path

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_stream(spark: SparkSession, path: str, schema: str | StructType = EVENT_SCHEMA, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once_each(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def tumbling(events: DataFrame, size: str = "1 day", slide: str | None = None, lateness: str = "1 day") -> DataFrame:
    """Events, users and value by type and window."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    e = events.withWatermark("ts", lateness) if events.isStreaming else events
    by = e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return by.select(F.col("w.start").alias("start"), "event_type", "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 day") -> DataFrame:
    e = events.withWatermark("ts", lateness) if events.isStreaming else events
    by = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return by.select("user_id", F.col("w.start").alias("started_at"), "events")


def with_dimension(events: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """A stream joined to a table."""
    return events.join(dimension, key, "left")


def throttled(events: DataFrame, key: str = "user_id", every_seconds: int = 3600) -> DataFrame:
    """Of each key's events, those at least so long after the last that was let through: state is one timestamp a key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["micros", "event_id"])
        kept = []
        for r in rows.itertuples(index=False):
            if last is None or r.micros - last >= every_seconds * 1_000_000:
                kept.append((k[0], r.event_id))
                last = r.micros
        state.update((last,))
        yield pd.DataFrame(kept, columns=[key, "event_id"])

    e = events.select(key, "event_id", F.unix_micros("ts").alias("micros"))
    return e.groupBy(key).applyInPandasWithState(step, f"{key} long, event_id long", "last long", "append", GroupStateTimeout.NoTimeout)


def apply_batches(events: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run a handler on each micro-batch up to the end of what there is; offsets are kept, so a restart goes on from there."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """Write each batch to a folder of its own number: a batch that is repeated after a failure replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def keep_latest_in(store: KeyedStore, version: str, key: str) -> Callable[[DataFrame, int], None]:
    """Last writer wins by event time: a late event never overwrites a newer row."""

    def handle(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy(key).agg(F.max_by(F.struct(*store.schema.names), F.struct(version, "event_id")).alias("r")).select("r.*")
        store._replace(cut(upsert(store.read(), rows, [key], version), "latest"))

    return handle


def dispatch(handlers: dict[str, Callable[[DataFrame], None]], event_type: str = "event_type") -> Callable[[DataFrame, int], None]:
    """Send each event of a batch to the handler of its kind; the others are ignored."""

    def handle(batch: DataFrame, number: int) -> None:
        routed = cut(batch.withColumn("_kind", route(event_type)), "routed")
        for kind, f in handlers.items():
            f(routed.where(F.col("_kind") == kind).drop("_kind"))

    return handle


def result_of(stream: DataFrame, name: str, checkpoint: str, mode: str) -> DataFrame:
    """Run a stream to its end into a table in the shared folder."""
    spark, path = stream.sparkSession, f"{checkpoint}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/offsets").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def in_order(batch: DataFrame, by: str) -> tuple[str, bool]:
    """Write rows so that a file stream reads them in order of `by`: (path, whether the store kept the order).

    A file stream takes files by modification time, so each file of the range gets a time of its own.
    """
    spark, path = batch.sparkSession, new_path(batch.sparkSession, "in-order")
    batch.repartitionByRange(by).sortWithinPartitions(by).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = lambda: [x for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-")]
    files = sorted(listed(), key=lambda x: int(x.getPath().getName().split("-")[1]))
    first = max((x.getModificationTime() for x in files), default=0) - 1000 * len(files)
    for i, x in enumerate(files):
        fs.setTimes(x.getPath(), first + 1000 * i, -1)
    kept = {x.getPath().getName(): x.getModificationTime() for x in listed()}
    times = [kept[x.getPath().getName()] for x in files]
    return path, all(a < b for a, b in zip(times, times[1:], strict=False))


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of its own rows in order of ts; all in one batch where the store can't keep an order."""
    batch = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path, ordered = in_order(batch.select("event_id", "ts", "user_id", "event_type", "value", "props"), "ts")
    return read_stream(spark, path, files_per_batch=100 if ordered else 2**31 - 1)


def _run(spark: SparkSession, stream: DataFrame, name: str, mode: str) -> DataFrame:
    return result_of(stream, name, new_path(spark, f"stream-{name}"), mode)


QUERIES = {
    "st1_tumbling_stream": lambda s, d: _run(s, tumbling(_events(s, d)), "tumbling", "complete").select("start", "event_type", "events", F.round("value", 6).alias("value")),
    "st9_dedup_stream": lambda s, d: _run(s, once_each(_events(s, d)), "dedup", "append").select("event_id", "event_type"),
    "st11_session_stream": lambda s, d: _run(s, sessions(_events(s, d)), "sessions", "complete"),
    "st12_throttle_stream": lambda s, d: _run(s, throttled(_events(s, d)), "throttle", "append").select("user_id", "event_id"),
    "st2_static_join_stream": lambda s, d: _run(s, with_dimension(_events(s, d), s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_mktsegment"), "user_id"), "static", "append").select("event_id", "c_mktsegment"),
}
SQL = {
    "st1_tumbling_stream": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events, round(sum(value), 6) AS value FROM events GROUP BY 1, 2",
    "st9_dedup_stream": "SELECT event_id, event_type FROM events",
    "st11_session_stream": "WITH x AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 1800000000, TRUE) AS new FROM events), y AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM x) SELECT user_id, min(ts) AS started_at, count(*) AS events FROM y GROUP BY user_id, session",
    "st12_throttle_stream": """WITH RECURSIVE e AS (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY 1, 2),
n AS (SELECT user_id, event_id, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM e),
t(user_id, event_id) AS (SELECT user_id, arg_min(event_id, ts) FROM e GROUP BY 1 UNION ALL SELECT n.user_id, n.following FROM t JOIN n ON n.event_id = t.event_id WHERE n.following IS NOT NULL)
SELECT * FROM t""",
    "st2_static_join_stream": "SELECT event_id, c_mktsegment FROM events LEFT JOIN customer ON c_custkey = user_id",
}
