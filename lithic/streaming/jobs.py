"""Job events as streams: redelivery, state folds, replay-safe sinks, leases, live counts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lithic.operators.snapshots import JOBS, RETRIES, job_states
from lithic.registry import query

ATTEMPTS, BACKOFF_MS = 3, 25
UNIT = ["snapshot_id", "unit_index"]


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """Events of a folder as a stream; timestamps without zone become instants for watermarks."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    plain = [f.name for f in rows.schema if f.dataType.simpleString() == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else rows


def without_redelivery(events: DataFrame, keys: list[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """Each message once; state goes when the watermark passes, so memory stays bounded."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OUT = "snapshot_id long, unit_index long, status string, retry_count long, cursor_at long, failure_reason string"
_KEPT = "done_id long, last_id long, last string, cursor_at long, failures long, top_id long, top_reason string"


def on_rocksdb(spark: SparkSession) -> None:
    """Keyed state with several variables and timers needs this store; its data lie on disk, not in the heap."""
    spark.conf.set(*ROCKSDB)


class JobFold(StatefulProcessor):
    """The state of a unit after the events so far, whatever the order they came in.

    One value holds the first completion, the newest event, and number and last
    of the failures before the completion. The failures themselves are a map by
    event, of which a batch reads only those it brings; a repeat is found there, a
    late event takes its place. Only a completion that comes before one that is
    known looks through the map, once, and drops what it puts an end to.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._job = handle.getValueState("job", _KEPT)
        self._failures = handle.getMapState("failures", "event_id long", "reason string")

    def handleInputRows(self, key, rows, timerValues):
        done, last_id, last, cursor, n, top, reason = self._job.get() if self._job.exists() else (None, -1, None, None, 0, None, None)
        for batch in rows:
            for event_id, event, cursor_at, why in zip(batch.event_id, batch.event, batch.cursor_at, batch.reason, strict=True):
                event_id = int(event_id)
                if event_id > last_id:
                    last_id, last, cursor = event_id, event, int(cursor_at)
                if event == "completed" and (done is None or event_id < done):
                    done = event_id
                    if top is not None and top > done:
                        n, top, reason = self._settle(done)
                elif event == "failure" and (done is None or event_id < done) and not self._failures.containsKey((event_id,)):
                    self._failures.updateValue((event_id,), (why,))
                    n += 1
                    if top is None or event_id > top:
                        top, reason = event_id, why
        self._job.update((done, last_id, last, cursor, n, top, reason))
        status = "completed" if done is not None else "failed" if n >= RETRIES else "retrying" if last == "failure" else "pending"
        yield pd.DataFrame([[*key, status, min(n, RETRIES), cursor, reason]], columns=["snapshot_id", "unit_index", "status", "retry_count", "cursor_at", "failure_reason"])

    def _settle(self, done: int) -> tuple:
        late = [k[0] for k in self._failures.keys() if k[0] >= done]
        for k in late:
            self._failures.removeKey((k,))
        n, top, reason = 0, None, None
        for (k,), (why,) in self._failures.iterator():
            n += 1
            if top is None or k > top:
                top, reason = k, why
        return n, top, reason


def job_state_stream(events: DataFrame) -> DataFrame:
    """The state of each unit as its events come: completed sticks, repeats change nothing, late events count in their place."""
    on_rocksdb(events.sparkSession)
    return events.groupBy(*UNIT).transformWithStateInPandas(JobFold(), _OUT, "Update", "None")


_LEASED = "snapshot_id long, unit_index long, state string, attempts long, reclaims long, not_before long, at_ms long, cause string"
_HELD = "state string, attempts long, reclaims long, since long, not_before long, last_id long"


class Leases(StatefulProcessor):
    """Claims with a lease and retries with a delay, on event time.

    A claim sets a timer at the end of its lease, a transient failure one at the
    time of the next attempt; both end in PENDING without any event of the unit.
    What has happened since makes a timer void. DONE and FAILED are final. Of
    the events of a unit that are not newer than the last one nothing comes.
    """

    def __init__(self, lease_ms: int) -> None:
        self._lease = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._job = handle.getValueState("job", _HELD)

    def _held(self) -> tuple:
        return self._job.get() if self._job.exists() else ("PENDING", 0, 0, None, None, -1)

    def handleInputRows(self, key, rows, timerValues):
        out = []
        events = pd.concat(list(rows)).sort_values("event_id", kind="stable")
        for event_id, event, at, transient in zip(events.event_id.astype(int), events.event, events.at_ms.astype(int), events.transient, strict=True):
            state, attempts, reclaims, _, not_before, last_id = self._held()
            if event_id <= last_id or state in ("DONE", "FAILED"):
                continue
            if event == "claimed":
                state, not_before = "CLAIMED", None
                self._handle.registerTimer(at + self._lease)
            elif event == "completed":
                state, not_before = "DONE", None
            elif event == "failure":
                attempts += 1
                again = bool(transient) and attempts < ATTEMPTS
                state, not_before = ("RETRYING", at + BACKOFF_MS * 2 ** (attempts - 1)) if again else ("FAILED", None)
                if again:
                    self._handle.registerTimer(not_before)
            self._job.update((state, attempts, reclaims, at, not_before, event_id))
            out.append((*key, state, attempts, reclaims, not_before, at, event))
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _LEASED.split(", ")]).astype({"not_before": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = expiredTimerInfo.getExpiryTimeInMs()
        state, attempts, reclaims, since, not_before, last_id = self._held()
        stale, due = state == "CLAIMED" and at >= since + self._lease, state == "RETRYING" and at >= not_before
        if stale or due:
            reclaims += int(stale)
            self._job.update(("PENDING", attempts, reclaims, at, None, last_id))
            yield pd.DataFrame([(*key, "PENDING", attempts, reclaims, None, at, "lease expired" if stale else "retry due")], columns=[f.split()[0] for f in _LEASED.split(", ")]).astype({"not_before": "Int64"})


def lease_stream(events: DataFrame, time: str, lease_ms: int, delay: str = "1 minute") -> DataFrame:
    """State changes of units from events(snapshot_id, unit_index, event_id, event, at_ms, transient, ``time``).

    Timers fire when the watermark, ``delay`` behind the newest event of any unit, passes them.
    """
    on_rocksdb(events.sparkSession)
    return events.withWatermark(time, delay).groupBy(*UNIT).transformWithStateInPandas(Leases(lease_ms), _LEASED, "Update", "EventTime")


def replay_safe_sink(keys: list[str], path: str, spark_dir_name: str = "batch"):
    """A ``foreachBatch`` writer: each micro-batch owns a partition that a replay overwrites with the same rows.

    Of several rows with one key the greatest stays, so a replay that comes in
    another order writes what was written before.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        rest = [c for c in rows.columns if c not in keys]
        once = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*").select(rows.columns) if rest else rows.distinct()
        once = once.withColumn(spark_dir_name, F.lit(batch_id))
        once.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(spark_dir_name).parquet(path)

    return write


def latest_rows(stored: DataFrame, keys: list[str], batch: str = "batch") -> DataFrame:
    """What a replay-safe sink holds: the newest row of each key."""
    newest = F.max_by(F.struct(*(c for c in stored.columns if c not in keys)), batch)
    return stored.groupBy(*keys).agg(newest.alias("r")).select(*keys, "r.*")


@query("str1", "SELECT snapshot_id, unit_index, event, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY copy) AS k FROM (SELECT *, 1 AS copy FROM job_events UNION ALL SELECT *, 2 FROM job_events WHERE event_id % 5 = 0) q) r WHERE k = 1")
def str1_redelivery(t):
    """The batch form on a log with every fifth event delivered twice."""
    events = t("job_events")
    return events.unionByName(events.where("event_id % 5 = 0")).dropDuplicates(["event_id"]).select(*UNIT, "event", "event_id")


@query("str2", f"SELECT snapshot_id, unit_index, status, retry_count, cursor_at, failure_reason FROM {JOBS}")
def str2_fold(t):
    """The batch twin of the state stream, on a log with events delivered twice."""
    events = t("job_events")
    once = events.unionByName(events.where("event_id % 7 = 0")).dropDuplicates(["event_id"])
    return job_states(once).select(*UNIT, "status", "retry_count", "cursor_at", "failure_reason")


@query("str3", "SELECT snapshot_id, unit_index, arg_max(event, event_id) AS event FROM job_events GROUP BY 1, 2")
def str3_sink(t):
    """What the sink holds after batches of a thousand events, one of them replayed."""
    batch = F.floor(F.col("event_id") / 1000).alias("batch")
    stored = t("job_events").groupBy(*UNIT, batch).agg(F.max_by("event", "event_id").alias("event"))
    return latest_rows(stored.unionByName(stored.where("batch = 3")), UNIT).select(*UNIT, "event")


def reclaim(jobs: DataFrame, as_of: Column, lease_ms: int) -> DataFrame:
    """jobs(state, claimed_at, not_before, reclaims): stale claims and retries that are due become pending."""
    stale = (F.col("state") == "CLAIMED") & (as_of - F.col("claimed_at") > lease_ms)
    due = (F.col("state") == "RETRYING") & (F.col("not_before") <= as_of)
    return jobs.withColumns({"state": F.when(stale | due, "PENDING").otherwise(F.col("state")), "reclaims": F.col("reclaims") + stale.cast("int")})


@query("str4", "SELECT event_id, CASE WHEN state = 'CLAIMED' AND now - at_ms > 86400000 OR state = 'RETRYING' AND at_ms + 3600000 <= now THEN 'PENDING' ELSE state END AS state, CASE WHEN state = 'CLAIMED' AND now - at_ms > 86400000 THEN 1 ELSE 0 END AS reclaims FROM (SELECT event_id, at_ms, CASE event WHEN 'pending' THEN 'CLAIMED' WHEN 'failure' THEN 'RETRYING' ELSE 'DONE' END AS state, (SELECT max(at_ms) FROM job_events) AS now FROM job_events) q")
def str4_reclaim(t):
    state = F.when(F.col("event") == "pending", "CLAIMED").when(F.col("event") == "failure", "RETRYING").otherwise("DONE")
    jobs = t("job_events").select("event_id", state.alias("state"), F.col("at_ms").alias("claimed_at"), (F.col("at_ms") + 3_600_000).alias("not_before"), F.lit(0).alias("reclaims"))
    now = jobs.agg(F.max("claimed_at").alias("now"))
    return reclaim(jobs.crossJoin(F.broadcast(now)), F.col("now"), 86_400_000).select("event_id", "state", "reclaims")  # one row


def backoff(attempts: Column, transient: Column, now: Column) -> tuple[Column, Column]:
    """State after a failed attempt and the time of the next one."""
    again = transient & (attempts < ATTEMPTS)
    return F.when(again, "RETRYING").otherwise("FAILED"), F.when(again, now + (BACKOFF_MS * F.pow(F.lit(2), attempts - 1)).cast("long"))


@query("str5", "SELECT event_id, CASE WHEN event_id % 4 <> 0 AND event_id % 5 + 1 < 3 THEN 'RETRYING' ELSE 'FAILED' END AS state, CASE WHEN event_id % 4 <> 0 AND event_id % 5 + 1 < 3 THEN at_ms + CAST(25 * pow(2, event_id % 5) AS BIGINT) END AS not_before FROM job_events WHERE event = 'failure'")
def str5_backoff(t):
    state, due = backoff(F.col("event_id") % 5 + 1, F.col("event_id") % 4 != 0, F.col("at_ms"))
    return t("job_events").where("event = 'failure'").select("event_id", state.alias("state"), due.alias("not_before"))


def ready(jobs: DataFrame, paused: DataFrame) -> DataFrame:
    """Pending jobs(snapshot_id, stage, state) of each unpaused snapshot's lowest open stage."""
    lowest = jobs.where("state not in ('DONE', 'FAILED')").groupBy("snapshot_id").agg(F.min("stage").alias("stage"))
    return jobs.join(lowest, ["snapshot_id", "stage"]).where("state = 'PENDING'").join(paused.select("snapshot_id"), "snapshot_id", "left_anti")


@query("str6", "WITH j AS (SELECT event_id, snapshot_id, unit_index % 3 AS stage, CASE event WHEN 'pending' THEN 'PENDING' WHEN 'failure' THEN 'RETRYING' ELSE 'DONE' END AS state FROM job_events) SELECT event_id, snapshot_id, stage FROM j WHERE state = 'PENDING' AND snapshot_id % 10 <> 0 AND stage = (SELECT min(stage) FROM j k WHERE k.snapshot_id = j.snapshot_id AND k.state NOT IN ('DONE', 'FAILED'))")
def str6_ready(t):
    state = F.when(F.col("event") == "pending", "PENDING").when(F.col("event") == "failure", "RETRYING").otherwise("DONE")
    jobs = t("job_events").select("event_id", "snapshot_id", (F.col("unit_index") % 3).alias("stage"), state.alias("state"))
    return ready(jobs, jobs.where("snapshot_id % 10 = 0").distinct()).select("event_id", "snapshot_id", "stage")


def live_counts(events: DataFrame, time: str, kind: str, delay: str = "1 day") -> DataFrame:
    """Events by day and kind; late ones count until the watermark passes."""
    timed = events.withWatermark(time, delay) if events.isStreaming else events
    day = F.window(time, "1 day")
    return timed.groupBy(day, kind).agg(F.count(F.lit(1)).alias("n")).select(F.date_format(F.col("window.start"), "yyyy-MM-dd").alias("day"), kind, "n")


@query("str7", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str7_live(t):
    return live_counts(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
