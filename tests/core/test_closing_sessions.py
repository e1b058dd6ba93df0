"""Sessions of a stream that close and leave no state, over a restart."""

import datetime

from tidelark.streaming import events, keyed

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_sessions_close_with_status_and_leave_no_state(spark, tmp_path):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    first = [(1, at(8, 0), 1, "view"), (2, at(8, 20), 1, "click"), (3, at(8, 5), 2, "view"), (4, at(8, 6), 2, "purchase"), (5, at(8, 7), 2, "error"), (6, at(9, 0), 3, "view")]
    second = [(7, at(9, 10), 3, "view"), (8, at(11, 0), 4, "error")]
    out, left = {}, []
    for number, rows in enumerate([first, second]):
        batch = spark.createDataFrame([(i, t, u, k, 0.0, "") for i, t, u, k in rows], SCHEMA)
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = keyed.closing_sessions(events.read_stream(spark, str(tmp_path / "in")))
        with keyed.large_state(spark):
            query = stream.writeStream.foreachBatch(events.append_to(str(tmp_path / f"out{number}"))).option("checkpointLocation", str(tmp_path / "offsets")).outputMode("append").trigger(availableNow=True).start()
            assert query.awaitTermination(120)
        found = spark.read.parquet(str(tmp_path / f"out{number}")).collect()
        out[number] = {(r.user_id, r.started_at.replace(tzinfo=None), r.ended_at.replace(tzinfo=None), r.events, r.status) for r in found}
        left.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    # User 1's gap is over when the watermark (9:00 less ten minutes) has come to 8:50.
    assert out[0] == {(2, at(8, 5), at(8, 6), 2, "completed"), (2, at(8, 7), at(8, 7), 1, "failed"), (1, at(8, 0), at(8, 20), 2, "expired")}
    # User 3's session goes on over the restart, and closes.
    assert out[1] == {(3, at(9, 0), at(9, 10), 2, "expired"), (4, at(11, 0), at(11, 0), 1, "failed")}
    assert left[0] > 0 and left[1] == 0


def test_the_session_store_is_put_back(spark):
    before = spark.conf.get(keyed.PROVIDER)
    with keyed.large_state(spark):
        assert spark.conf.get(keyed.PROVIDER) == keyed.ROCKS
    assert spark.conf.get(keyed.PROVIDER) == before
