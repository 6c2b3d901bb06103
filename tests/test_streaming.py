"""Streams give what their batch twins give, replays and late rows included."""

from pyspark.sql import functions as F

from lithic.operators.snapshots import job_states
from lithic.streaming.jobs import job_state_stream, latest_rows, live_counts, replay_safe_sink, stream_of, without_redelivery
from lithic.views import Tables


def parts(rows, column, folder, n=4):
    """Rows in files by ranges of a column, one of them delivered twice."""
    most = rows.agg(F.max(column)).first()[0]
    for k in [*range(n), 1]:
        part = rows.where((F.col(column) * n > most * k) & (F.col(column) * n <= most * (k + 1)) | ((F.col(column) == 0) & F.lit(k == 0)))
        part.coalesce(1).write.mode("append").parquet(str(folder))


def finish(frame, name, mode):
    stream = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    stream.awaitTermination(180)
    assert stream.exception() is None
    return frame.sparkSession.table(name)


def test_job_state_stream(spark, small, tmp_path):
    events = Tables(spark, small)("job_events").where("snapshot_id % 3 = 0").cache()
    parts(events, "event_id", tmp_path / "in")
    seen = finish(job_state_stream(stream_of(spark, str(tmp_path / "in"), events.schema)), "job_states", "update")
    last = {}
    for r in seen.collect():
        last[r.snapshot_id, r.unit_index] = (r.status, r.retry_count, r.cursor_at, r.failure_reason)
    twin = {(r.snapshot_id, r.unit_index): (r.status, r.retry_count, r.cursor_at, r.failure_reason) for r in job_states(events).collect()}
    assert {k: v[0] for k, v in last.items()} == {k: v[0] for k, v in twin.items()} and last == twin


def test_redelivery_and_live_counts(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").select("event_id", "ts", "event_type")
    parts(events, "event_id", tmp_path / "in")
    stream = stream_of(spark, str(tmp_path / "in"), events.schema)
    once = finish(without_redelivery(stream, ["event_id"], "ts", "1000 days"), "once", "append")
    assert once.count() == events.count() == once.distinct().count()
    counted = finish(live_counts(stream, "ts", "event_type", "1000 days"), "live", "complete")
    assert counted.agg(F.sum("n")).first()[0] > events.count()


def test_replayed_batches_change_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    write = replay_safe_sink(["k"], path)
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    for batch, rows in ((0, [(1, "a"), (2, "a")]), (1, [(1, "b")]), (0, [(1, "a"), (2, "a")]), (1, [(1, "b")])):
        write(frame(rows), batch)
    assert {(r.k, r.v) for r in latest_rows(spark.read.parquet(path), ["k"]).select("k", "v").collect()} == {(1, "b"), (2, "a")}
