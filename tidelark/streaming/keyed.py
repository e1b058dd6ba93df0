"""Keyed state that expires: sessions that close, by timers in event time.

State is one value for each key with an open session, in RocksDB on the executors and in the checkpoint: it may be larger than
memory, a restart goes on with it, and none is left of sessions that are over.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelark.streaming.events import _events, result_of
from tidelark.sources.stores import new_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Kinds of events that end a session, with the status that they give.
ENDS = {"purchase": "completed", "error": "failed"}


@contextlib.contextmanager
def large_state(spark: SparkSession) -> Iterator[None]:
    """The state store that timers take, for streams that begin meanwhile."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Sessions(StatefulProcessor):
    """Of each key: start, last event and count of the open session."""

    def __init__(self, gap_ms: int, ends: dict[str, str]):
        self.gap, self.ends = gap_ms, ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("session", "started long, last long, events long")

    def _closed(self, key: tuple, started: int, last: int, events: int, status: str) -> tuple:
        return (key[0], started, last, events, status)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, now = [], self.open.get() if self.open.exists() else None
        if now is not None:
            self.handle.deleteTimer(now[1] // 1000 + self.gap)
        for r in pd.concat(list(rows)).sort_values(["micros", "event_id"]).itertuples(index=False):
            if now is not None and r.micros - now[1] >= self.gap * 1000:
                out.append(self._closed(key, *now, "expired"))
                now = None
            now = (r.micros, r.micros, 1) if now is None else (min(now[0], r.micros), max(now[1], r.micros), now[2] + 1)
            if r.event_type in self.ends:
                out.append(self._closed(key, *now, self.ends[r.event_type]))
                now = None
        if now is None:
            self.open.clear()
        else:
            self.open.update(tuple(int(v) for v in now))
            self.handle.registerTimer(int(now[1]) // 1000 + self.gap)
        yield pd.DataFrame(out, columns=["key", "started", "last", "events", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.open.get()
        self.open.clear()
        yield pd.DataFrame([self._closed(key, *now, "expired")], columns=["key", "started", "last", "events", "status"])

    def close(self) -> None:
        pass


def closing_sessions(events: DataFrame, gap_seconds: int = 1800, lateness: str = "10 minutes", ends: dict[str, str] | None = None) -> DataFrame:
    """user_id, started_at, ended_at, events, status of sessions of a stream, each once it is over: an event of a kind that ends it
    has come (status by `ends`), or none for the gap (`expired`, once the watermark is past it).  Events of a key that come late,
    within the lateness, join the session that is open then."""
    x = events.withWatermark("ts", lateness).select("user_id", "event_id", "event_type", "ts", F.unix_micros("ts").alias("micros"))
    closed = x.groupBy("user_id").transformWithStateInPandas(Sessions(gap_seconds * 1000, ENDS if ends is None else ends), "key long, started long, last long, events long, status string", "append", "eventTime")
    return closed.select(F.col("key").alias("user_id"), F.timestamp_micros("started").alias("started_at"), F.timestamp_micros("last").alias("ended_at"), "events", "status")


def _run(s: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    with large_state(s):
        return result_of(stream, name, new_path(s, f"stream-{name}"), "append")


QUERIES = {
    "st11_closing_sessions": lambda s, d: _run(s, closing_sessions(_events(s, d)), "closing").select("user_id", "started_at", "ended_at", "events", "status"),
}
SQL = {
    "st11_closing_sessions": """WITH x AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000 OR lag(event_type) OVER w IN ('purchase', 'error'), TRUE) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM x),
z AS (SELECT user_id, session, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS events, arg_max(event_type, (ts, event_id)) AS kind FROM y GROUP BY 1, 2)
SELECT user_id, started_at, ended_at, events, CASE kind WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'expired' END AS status FROM z
WHERE kind IN ('purchase', 'error') OR ended_at + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE OR EXISTS (SELECT 1 FROM z n WHERE n.user_id = z.user_id AND n.session = z.session + 1)""",
}
