"""Leases and retries as a stream: timers fire without events of their unit, and state outlives a restart."""

import datetime

from lithic.streaming.jobs import lease_stream

SCHEMA = "snapshot_id long, unit_index long, event_id long, event string, at_ms long, transient boolean, ts timestamp"
START = 1_700_000_000_000
LEASE = 60_000


def test_timers_and_restart(spark, tmp_path):
    source, marks = str(tmp_path / "in"), str(tmp_path / "marks")
    seen = []

    def event(unit, event_id, kind, after_ms, transient=True):
        at = START + after_ms
        return (1, unit, event_id, kind, at, transient, datetime.datetime.fromtimestamp(at / 1000))

    def deliver(*events):
        """More events, read by a query that starts from its checkpoint."""
        spark.createDataFrame(list(events), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        changes = lease_stream(stream, "ts", LEASE, "1 second")
        query = changes.writeStream.outputMode("update").option("checkpointLocation", marks).trigger(availableNow=True)
        found = []
        query = query.foreachBatch(lambda rows, _: found.extend(rows.collect())).start()
        query.awaitTermination(180)
        assert query.exception() is None
        new = sorted((r.unit_index, r.at_ms - START, r.state, r.attempts, r.reclaims, r.not_before and r.not_before - START, r.cause) for r in found)
        seen.extend(new)
        return new

    assert deliver(event(1, 1, "claimed", 0), event(2, 2, "claimed", 0), event(2, 3, "failure", 10), event(3, 4, "claimed", 5), event(3, 5, "completed", 20)) == [
        (1, 0, "CLAIMED", 0, 0, None, "claimed"), (2, 0, "CLAIMED", 0, 0, None, "claimed"), (2, 10, "RETRYING", 1, 0, 35, "failure"), (3, 5, "CLAIMED", 0, 0, None, "claimed"), (3, 20, "DONE", 0, 0, None, "completed"),
    ]
    # after a restart, another unit's event moves time on: a retry falls due, no lease ends yet
    assert deliver(event(9, 6, "claimed", 30_000)) == [(2, 35, "PENDING", 1, 0, None, "retry due"), (9, 30_000, "CLAIMED", 0, 0, None, "claimed")]
    # a second failure waits twice as long; the lease of unit 1 ends, attempts unchanged; the one of unit 2 was void
    assert deliver(event(2, 7, "claimed", 30_100), event(2, 8, "failure", 30_200), event(9, 9, "completed", 62_000)) == [
        (1, 60_000, "PENDING", 0, 1, None, "lease expired"), (2, 30_100, "CLAIMED", 1, 1 - 1, None, "claimed"), (2, 30_200, "RETRYING", 2, 0, 30_250, "failure"), (2, 30_250, "PENDING", 2, 0, None, "retry due"), (9, 62_000, "DONE", 0, 0, None, "completed"),
    ]
    # the third failure is final, one that is not transient at once; repeats and what comes after the end change nothing
    assert deliver(event(2, 10, "failure", 63_000), event(2, 11, "claimed", 63_100), event(5, 12, "failure", 63_000, False), event(3, 5, "completed", 20), event(1, 1, "claimed", 0)) == [(2, 63_000, "FAILED", 3, 0, None, "failure"), (5, 63_000, "FAILED", 1, 0, None, "failure")]
    assert deliver(event(8, 13, "claimed", 900_000)) == [(8, 900_000, "CLAIMED", 0, 0, None, "claimed")]
