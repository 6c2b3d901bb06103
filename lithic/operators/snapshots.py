"""Versioned file inventories: snapshots, attempts, jobs, history and diffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic.registry import query

RETRIES, PAGE, MOST_PAGE, BATCH = 5, 100, 500, 200
ATTEMPT = ["repository_id", "commit_sha"]


def get_or_create(known: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` that are new, once each."""
    return wanted.dropDuplicates(keys).join(known.select(keys), keys, "left_anti")


@query("snp1", "SELECT DISTINCT split_part(full_name, '/', 1) AS owner, split_part(full_name, '/', 2) AS name FROM repo_sources WHERE id NOT IN (SELECT id FROM repos WHERE archived)")
def snp1_get_or_create(t):
    """Repositories of all sources that are not among the archived ones, which are known already."""
    named = lambda rows: rows.select(F.substring_index("full_name", "/", 1).alias("owner"), F.substring_index("full_name", "/", -1).alias("name"))
    return get_or_create(named(t("repos").where("archived")), named(t("repo_sources")), ["owner", "name"])


@query("snp2", "SELECT repository_id, concat('ref', id % 3) AS ref, arg_max(commit_sha, id) AS commit_sha FROM snapshots GROUP BY 1, 2")
def snp2_latest_ref(t):
    return t("snapshots").groupBy("repository_id", F.concat(F.lit("ref"), F.col("id") % 3).alias("ref")).agg(F.max_by("commit_sha", "id").alias("commit_sha"))


def resolve(snapshots: DataFrame) -> DataFrame:
    """The attempt that stands for each commit: a completed one, else the latest open one."""
    completed = F.col("status") == "completed"
    open_ = snapshots.where("status <> 'failed'")
    best = open_.groupBy(*ATTEMPT).agg(F.max_by(F.struct("id", "status", "attempt_number"), F.struct(completed.cast("int"), "attempt_number")).alias("s"))
    return best.select(*ATTEMPT, "s.*")


@query("snp3", "SELECT repository_id, commit_sha, id, status, attempt_number FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, commit_sha ORDER BY status = 'completed' DESC, attempt_number DESC) AS k FROM snapshots WHERE status <> 'failed') q WHERE k = 1")
def snp3_resolve(t):
    return resolve(t("snapshots"))


@query("snp4", "WITH r AS (SELECT DISTINCT user_id % 30 + 1 AS repository_id FROM events) SELECT r.repository_id, coalesce(max(attempt_number), 0) + 1 AS attempt_number, 'pending' AS status FROM r LEFT JOIN snapshots s USING (repository_id) GROUP BY 1")
def snp4_next_attempt(t):
    wanted = t("events").select((F.col("user_id") % 30 + 1).alias("repository_id")).distinct()
    last = t("snapshots").groupBy("repository_id").agg(F.max("attempt_number").alias("last"))
    return wanted.join(last, "repository_id", "left").select("repository_id", (F.coalesce("last", F.lit(0)) + 1).alias("attempt_number"), F.lit("pending").alias("status"))


def acquisition_modes(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    done = snapshots.where("status = 'completed'").select("repository_id", F.lit(True).alias("done")).distinct()
    return requests.join(done, "repository_id", "left").withColumn("mode", F.when(F.col("done"), "incremental_api").otherwise("bulk_archive")).drop("done")


@query("snp5", "WITH r AS (SELECT DISTINCT user_id % 30 + 1 AS repository_id FROM events) SELECT repository_id, CASE WHEN EXISTS (SELECT 1 FROM snapshots s WHERE s.repository_id = r.repository_id AND status = 'completed') THEN 'incremental_api' ELSE 'bulk_archive' END AS mode FROM r")
def snp5_modes(t):
    wanted = t("events").select((F.col("user_id") % 30 + 1).alias("repository_id")).distinct()
    return acquisition_modes(wanted, t("snapshots"))


def acquire(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Reuse the attempt that stands for a requested commit, or open the next one."""
    found = resolve(snapshots)
    last = snapshots.groupBy(*ATTEMPT).agg(F.max("attempt_number").alias("last"))
    joined = acquisition_modes(requests, snapshots).join(found, ATTEMPT, "left").join(last, ATTEMPT, "left")
    return joined.select(*ATTEMPT, F.when(F.col("id").isNull(), "new").otherwise("reuse").alias("action"), F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("attempt_number", F.coalesce("last", F.lit(0)) + 1).alias("attempt_number"), "mode")


_RESOLVED = "(SELECT repository_id, commit_sha, id, status, attempt_number FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, commit_sha ORDER BY status = 'completed' DESC, attempt_number DESC) AS k FROM snapshots WHERE status <> 'failed') q WHERE k = 1)"


@query("snp6", f"""WITH r AS (SELECT DISTINCT repository_id, commit_sha FROM snapshots), s AS (SELECT * FROM snapshots), m AS (SELECT repository_id, commit_sha, max(attempt_number) AS last FROM s GROUP BY 1, 2)
    SELECT r.repository_id, r.commit_sha, CASE WHEN f.id IS NULL THEN 'new' ELSE 'reuse' END AS action, coalesce(f.status, 'pending') AS status, coalesce(f.attempt_number, coalesce(last, 0) + 1) AS attempt_number,
    CASE WHEN r.repository_id IN (SELECT repository_id FROM s WHERE status = 'completed') THEN 'incremental_api' ELSE 'bulk_archive' END AS mode FROM r LEFT JOIN {_RESOLVED} f USING (repository_id, commit_sha) LEFT JOIN m USING (repository_id, commit_sha)""")
def snp6_acquire(t):
    rows = t("snapshots")
    return acquire(rows.select(*ATTEMPT).distinct(), rows)


def job_states(events: DataFrame, budget: int = RETRIES) -> DataFrame:
    """State of each unit after its events in order: completed sticks, failures count against the budget."""
    unit = ["snapshot_id", "unit_index"]
    done = F.bool_or(F.col("event") == "completed")
    # one row a unit, joined: a unit of any number of events is not held by one task
    first_done = events.where("event = 'completed'").groupBy(*unit).agg(F.min("event_id").alias("_done"))
    failures = events.join(first_done, unit, "left")
    early = F.col("_done").isNull() | (F.col("event_id") < F.col("_done"))
    failed = F.count_if((F.col("event") == "failure") & early)
    last = F.max_by("event", "event_id")
    state = F.when(done, "completed").when(failed >= budget, "failed").when(last == "failure", "retrying").otherwise("pending")
    return failures.groupBy("snapshot_id", "unit_index").agg(
        state.alias("status"), F.least(failed, F.lit(budget)).alias("retry_count"), F.max_by("cursor_at", "event_id").alias("cursor_at"),
        F.max_by("reason", F.when((F.col("event") == "failure") & early, F.col("event_id"))).alias("failure_reason"), F.sum("files_processed").alias("files_processed"), F.sum("bytes_processed").alias("bytes_processed"),
    )


JOBS = """(SELECT snapshot_id, unit_index, CASE WHEN bool_or(event = 'completed') THEN 'completed' WHEN count(*) FILTER (WHERE event = 'failure' AND early) >= 5 THEN 'failed' WHEN arg_max(event, event_id) = 'failure' THEN 'retrying' ELSE 'pending' END AS status,
  least(count(*) FILTER (WHERE event = 'failure' AND early), 5) AS retry_count, arg_max(cursor_at, event_id) AS cursor_at, arg_max(reason, event_id) FILTER (WHERE event = 'failure' AND early) AS failure_reason,
  sum(files_processed)::BIGINT AS files_processed, sum(bytes_processed)::BIGINT AS bytes_processed FROM (SELECT *, coalesce(event_id < min(event_id) FILTER (WHERE event = 'completed') OVER (PARTITION BY snapshot_id, unit_index), true) AS early FROM job_events) e GROUP BY 1, 2) jobs"""


@query("snp7", f"""WITH j AS (SELECT snapshot_id, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS done FROM {JOBS} GROUP BY 1), s AS (SELECT *, bool_or(status = 'completed') OVER (PARTITION BY repository_id, commit_sha) AS sibling FROM snapshots)
    SELECT id, coalesce(n > 0 AND n = done AND NOT sibling AND status NOT IN ('completed', 'failed'), false) AS completes FROM s LEFT JOIN j ON j.snapshot_id = s.id""")
def snp7_finalize(t):
    return finalize(t("snapshots"), job_states(t("job_events")))


def finalize(snapshots: DataFrame, jobs: DataFrame) -> DataFrame:
    """Which attempts complete now: all jobs done, none of the commit's attempts completed before."""
    counts = jobs.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "completed").alias("done"))
    completed = snapshots.where("status = 'completed'").select(*ATTEMPT, F.lit(True).alias("sibling")).distinct()
    joined = snapshots.join(counts, snapshots.id == counts.snapshot_id, "left").join(completed, ATTEMPT, "left")
    ready = (F.col("n") == F.col("done")) & F.col("sibling").isNull() & ~F.col("status").isin("completed", "failed")
    return joined.select("id", F.coalesce(ready, F.lit(False)).alias("completes"))


@query("snp8", "SELECT id, status, CASE WHEN id % 2 = 0 AND status = 'pending' THEN 'in_progress' WHEN id % 2 = 1 AND status NOT IN ('completed', 'failed') THEN 'failed' ELSE status END AS next FROM snapshots")
def snp8_transitions(t):
    return t("snapshots").select("id", "status", transition(F.col("status"), F.col("id") % 2 == 0, F.col("id") % 2 == 1).alias("next"))


def transition(status: Column, start: Column, fail: Column) -> Column:
    return F.when(start & (status == "pending"), "in_progress").when(fail & ~status.isin("completed", "failed"), "failed").otherwise(status)


@query("snp9", "SELECT id, snapshot_id, path FROM files_head h WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.snapshot_id = h.snapshot_id AND f.path = h.path AND f.id % 2 = 0)")
def snp9_append(t):
    return get_or_create(t("files").where("id % 2 = 0"), t("files_head"), ["snapshot_id", "path"]).select("id", "snapshot_id", "path")


@query("snp10", "SELECT r.doc_id AS request, f.id, f.size_bytes, concat('snapshots/forge/', r.snapshot_id, '/', f.content_hash) AS content_key FROM (SELECT doc_id, snapshot_id, CASE WHEN doc_id % 4 = 0 THEN 'none' ELSE path END AS path FROM files WHERE doc_id % 3 = 0) r LEFT JOIN files f ON f.snapshot_id = r.snapshot_id AND f.path = r.path")
def snp10_lookup(t):
    requests = t("files").where("doc_id % 3 = 0").select(F.col("doc_id").alias("request"), "snapshot_id", F.when(F.col("doc_id") % 4 == 0, "none").otherwise(F.col("path")).alias("path"))
    found = requests.join(t("files").select("snapshot_id", "path", "id", "size_bytes", "content_hash"), ["snapshot_id", "path"], "left")
    return found.select("request", "id", "size_bytes", F.when(F.col("content_hash").isNotNull(), F.concat(F.lit("snapshots/forge/"), "snapshot_id", F.lit("/"), "content_hash")).otherwise(F.concat(F.lit("snapshots/forge/"), "snapshot_id", F.lit("/"))).alias("content_key"))


def keyset_page(rows: DataFrame, cursor: int, limit: int = PAGE) -> DataFrame:
    """The rows after a cursor with the cursor of the next page, null on the last."""
    limit = min(limit, MOST_PAGE)
    ahead = rows.where(F.col("id") > cursor).orderBy("id").limit(limit + 1)
    ranked = ahead.withColumns({"_k": F.row_number().over(W.orderBy("id")), "_n": F.count(F.lit(1)).over(W.partitionBy())})
    last = F.max(F.when(F.col("_k") == limit, F.col("id"))).over(W.partitionBy())
    return ranked.withColumn("next_cursor", F.when(F.col("_n") > limit, last)).where(F.col("_k") <= limit).drop("_k", "_n")


@query("snp11", "WITH p AS (SELECT id, path, row_number() OVER (ORDER BY id) AS k FROM files WHERE snapshot_id = 3 AND id > 100) SELECT id, path, CASE WHEN (SELECT count(*) FROM p) > 20 THEN (SELECT id FROM p WHERE k = 20) END AS next_cursor FROM p WHERE k <= 20")
def snp11_page(t):
    return keyset_page(t("files").where("snapshot_id = 3").select("id", "path"), 100, 20)


@query("snp12", f"SELECT snapshot_id, unit_index, status = 'completed' AS completed, cursor_at FROM {JOBS}")
def snp12_sticky(t):
    return job_states(t("job_events")).select("snapshot_id", "unit_index", (F.col("status") == "completed").alias("completed"), "cursor_at")


@query("snp13", "SELECT snapshot_id, count(*) AS files_processed, sum(size_bytes)::BIGINT AS bytes_processed FROM files GROUP BY 1")
def snp13_counters(t):
    return t("files").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("files_processed"), F.sum("size_bytes").alias("bytes_processed"))


@query("snp14", f"SELECT snapshot_id, unit_index, status, retry_count, failure_reason FROM {JOBS}")
def snp14_mutations(t):
    return job_states(t("job_events")).select("snapshot_id", "unit_index", "status", "retry_count", "failure_reason")


@query("snp15", f"SELECT snapshot_id, count(*) FILTER (WHERE status = 'failed') AS failed_units, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status = 'completed') THEN 'completed' ELSE 'in_progress' END AS status FROM {JOBS} GROUP BY 1")
def snp15_budget(t):
    jobs, is_ = job_states(t("job_events")), lambda s: F.col("status") == s
    return jobs.groupBy("snapshot_id").agg(F.count_if(is_("failed")).alias("failed_units"), F.when(F.bool_or(is_("failed")), "failed").when(F.bool_and(is_("completed")), "completed").otherwise("in_progress").alias("status"))


def jobs_summary(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("units_total"), F.count_if(F.col("status") == "completed").alias("units_completed"), F.coalesce(F.sum("files_processed"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes_processed"), F.lit(0)).alias("bytes"))


_SUMMARY = f"(SELECT snapshot_id, count(*) AS units_total, count(*) FILTER (WHERE status = 'completed') AS units_completed, sum(files_processed)::BIGINT AS files, sum(bytes_processed)::BIGINT AS bytes FROM {JOBS} GROUP BY 1)"


@query("snp16", f"SELECT * FROM {_SUMMARY} s")
def snp16_summary(t):
    return jobs_summary(job_states(t("job_events")))


@query("snp17", f"SELECT id, status, CASE WHEN status IN ('completed', 'failed') THEN coalesce(units_total, 0) END AS units_total, coalesce(units_completed, 0) AS units_completed, coalesce(files, 0) AS files, coalesce(bytes, 0) AS bytes FROM snapshots LEFT JOIN {_SUMMARY} s ON s.snapshot_id = id")
def snp17_status(t):
    return snapshot_status(t("snapshots"), job_states(t("job_events")))


def snapshot_status(snapshots: DataFrame, jobs: DataFrame) -> DataFrame:
    """Status and counters of each snapshot; the total is known once it has ended."""
    joined = snapshots.join(jobs_summary(jobs), F.col("id") == F.col("snapshot_id"), "left")
    or0 = lambda c: F.coalesce(c, F.lit(0))
    return joined.select("id", "status", F.when(F.col("status").isin("completed", "failed"), or0("units_total")).alias("units_total"), *(or0(c).alias(c) for c in ("units_completed", "files", "bytes")))


@query("snp18", """WITH s AS (SELECT user_id % 25 + 1 AS repository_id, user_id % 60 AS c, event_id, event_type, epoch_us(ts) // 1000 AS at FROM events), o AS (SELECT *, max(event_id) FILTER (WHERE event_type IN ('signup', 'view')) OVER (PARTITION BY repository_id, c ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened FROM s)
    SELECT o.event_id, o.opened, o.at - s.at AS duration_ms FROM o JOIN s ON s.event_id = o.opened WHERE o.event_type = 'purchase'""")
def snp18_durations(t):
    rows = t("events").select((F.col("user_id") % 25 + 1).alias("repository_id"), (F.col("user_id") % 60).alias("c"), "event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return durations(rows, F.col("event_type").isin("signup", "view"), F.col("event_type") == "purchase")


def durations(rows: DataFrame, opens: Column, closes: Column) -> DataFrame:
    """Each closing row with the latest opening before it and the time between."""
    before = W.partitionBy("repository_id", "c").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(opens, F.struct("event_id", "at")), ignorenulls=True).over(before)
    return rows.withColumn("o", last).where(closes & F.col("o").isNotNull()).select("event_id", F.col("o.event_id").alias("opened"), (F.col("at") - F.col("o.at")).alias("duration_ms"))


@query("snp19", "SELECT repository_id, id, row_number() OVER (PARTITION BY repository_id ORDER BY completed_at DESC, id DESC) AS newest FROM snapshots WHERE status = 'completed'")
def snp19_history(t):
    newest = F.row_number().over(W.partitionBy("repository_id").orderBy(F.desc("completed_at"), F.desc("id"))).cast("long")
    return t("snapshots").where("status = 'completed'").select("repository_id", "id", newest.alias("newest"))


@query("snp20", "SELECT id, lag(id) OVER (PARTITION BY repository_id ORDER BY completed_at, id) AS baseline FROM snapshots WHERE status = 'completed'")
def snp20_baseline(t):
    return t("snapshots").where("status = 'completed'").select("id", F.lag("id").over(W.partitionBy("repository_id").orderBy("completed_at", "id")).alias("baseline"))


@query("snp21", "SELECT id, sha256(text) AS content_hash, concat_ws('/', 'snapshots', 'forge', 'owner', concat('r', snapshot_id), sha256(text)) AS content_key FROM files")
def snp21_address(t):
    digest = F.sha2("text", 256)
    return t("files").select("id", digest.alias("content_hash"), F.concat_ws("/", F.lit("snapshots"), F.lit("forge"), F.lit("owner"), F.concat(F.lit("r"), "snapshot_id"), digest).alias("content_key"))


def snapshot_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """Added, modified and removed paths between two inventories(snapshot_id, path, content_hash)."""
    keys = ["snapshot_id", "path"]
    a = base.select(*keys, F.col("content_hash").alias("old"))
    b = head.select(*keys, F.col("content_hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change_type")).where("change_type is not null")


_DIFF = "(SELECT coalesce(a.snapshot_id, b.snapshot_id) AS snapshot_id, coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change_type FROM files a FULL JOIN files_head b ON a.snapshot_id = b.snapshot_id AND a.path = b.path WHERE a.content_hash IS DISTINCT FROM b.content_hash)"


@query("snp22", f"SELECT h.id, h.path FROM {_DIFF} d JOIN files_head h ON h.snapshot_id = d.snapshot_id AND h.path = d.path WHERE change_type <> 'removed'")
def snp22_incremental(t):
    changes = snapshot_diff(t("files"), t("files_head")).where("change_type <> 'removed'")
    return t("files_head").join(changes, ["snapshot_id", "path"]).select("id", "path")


@query("snp23", f"SELECT * FROM {_DIFF} d")
def snp23_diff(t):
    return snapshot_diff(t("files"), t("files_head"))


def purge(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given snapshots."""
    ids = gone.select("snapshot_id").distinct()
    return {name: table.join(ids, "snapshot_id", "left_anti") for name, table in tables.items()}


@query("snp24", "SELECT 'files' AS name, count(*) AS n FROM files WHERE snapshot_id % 4 <> 0 UNION ALL SELECT 'extractions', count(*) FROM extractions WHERE snapshot_id % 4 <> 0 UNION ALL SELECT 'directories', count(*) FROM directories WHERE snapshot_id % 4 <> 0")
def snp24_purge(t):
    left = purge({n: t(n) for n in ("files", "extractions", "directories")}, t("files").where("snapshot_id % 4 = 0"))
    return reduce(DataFrame.unionByName, (f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, f in left.items()))


STATES = ["pending", "in_progress", "completed", "failed"]


def status_tally(rows: DataFrame, states: list[str]) -> DataFrame:
    names = rows.sparkSession.createDataFrame([(s,) for s in states], "status string")
    counts = rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@query("snp25", "SELECT 'snapshot' AS kind, v.status, count(id) AS n FROM (VALUES ('pending'), ('in_progress'), ('completed'), ('failed')) v(status) LEFT JOIN (SELECT * FROM snapshots WHERE status <> 'failed') s ON s.status = v.status GROUP BY 2 UNION ALL SELECT 'extraction', v.status, count(file_id) FROM (VALUES ('extracted'), ('skipped_unsupported'), ('failed'), ('waiting')) v(status) LEFT JOIN extractions e ON e.status = v.status GROUP BY 2")
def snp25_tally(t):
    a = status_tally(t("snapshots").where("status <> 'failed'"), STATES).select(F.lit("snapshot").alias("kind"), "status", "n")
    return a.unionByName(status_tally(t("extractions"), ["extracted", "skipped_unsupported", "failed", "waiting"]).select(F.lit("extraction").alias("kind"), "status", "n"))


@query("snp26", r"""WITH f AS (SELECT f.size_bytes, e.language, CASE WHEN regexp_matches(f.path, '\.[^./]+$') THEN lower(regexp_extract(f.path, '\.([^./]+)$', 1)) ELSE '(none)' END AS ext FROM files f LEFT JOIN extractions e ON e.file_id = f.id)
    SELECT 'total' AS kind, '' AS name, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM f UNION ALL SELECT 'language', language, count(*), sum(size_bytes)::BIGINT FROM f WHERE language IS NOT NULL GROUP BY language UNION ALL SELECT * FROM (SELECT 'extension', ext, count(*) AS n, sum(size_bytes)::BIGINT FROM f GROUP BY ext ORDER BY n DESC, ext LIMIT 12) x""")
def snp26_inventory(t):
    from lithic.sources.paths import extension_of

    ext = extension_of(F.col("path"))
    rows = t("files").join(t("extractions").select(F.col("file_id").alias("id"), "language"), "id", "left").select("size_bytes", "language", F.when(ext == "", "(none)").otherwise(ext).alias("ext"))
    size = [F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes")]
    parts = [
        rows.agg(*size).select(F.lit("total").alias("kind"), F.lit("").alias("name"), "n", "bytes"),
        rows.where("language is not null").groupBy(F.col("language").alias("name")).agg(*size).select(F.lit("language").alias("kind"), "name", "n", "bytes"),
        rows.groupBy(F.col("ext").alias("name")).agg(*size).orderBy(F.desc("n"), "name").limit(12).select(F.lit("extension").alias("kind"), "name", "n", "bytes"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("snp26_shares", "SELECT snapshot_id, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, count(language) AS supported_files, coalesce(sum(size_bytes) FILTER (WHERE language IS NOT NULL), 0)::BIGINT AS supported_bytes, round(coalesce(count(*) FILTER (WHERE language = 'java') / nullif(count(language), 0), 0), 9) AS java_share, round(coalesce(count(*) FILTER (WHERE language IN ('javascript', 'typescript', 'tsx')) / nullif(count(language), 0), 0), 9) AS script_share FROM (SELECT f.snapshot_id, f.size_bytes, e.language FROM files f LEFT JOIN extractions e ON e.file_id = f.id) q GROUP BY 1")
def snp26_shares(t):
    rows = t("files").join(t("extractions").select(F.col("file_id").alias("id"), "language"), "id", "left")
    return language_shares(rows)


def language_shares(rows: DataFrame) -> DataFrame:
    """Files and bytes of each snapshot, those in supported languages, and the shares of Java and of scripts among them."""
    known, one_of = F.count("language"), lambda *names: F.count_if(F.col("language").isin(*names))
    share = lambda n: F.round(F.coalesce(n / F.nullif(known, F.lit(0)), F.lit(0.0)), 9)
    supported = F.coalesce(F.sum(F.when(F.col("language").isNotNull(), F.col("size_bytes"))), F.lit(0))
    return rows.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), known.alias("supported_files"), supported.alias("supported_bytes"), share(one_of("java")).alias("java_share"), share(one_of("javascript", "typescript", "tsx")).alias("script_share"))


# ---- fixed values: upper ends of the size buckets in bytes
BUCKETS = [4096, 16384, 65536, 262144, 524288, 1048576, 4194304, 10485760]


@query("snp27", "WITH b AS (SELECT * FROM (VALUES (0, 0, 4096), (1, 4096, 16384), (2, 16384, 65536), (3, 65536, 262144), (4, 262144, 524288), (5, 524288, 1048576), (6, 1048576, 4194304), (7, 4194304, 10485760), (8, 10485760, NULL)) v(place, above, upto)) SELECT place, upto, count(file_id) AS n FROM b LEFT JOIN (SELECT * FROM extractions WHERE language IS NOT NULL) e ON (size_bytes > above OR (above = 0 AND size_bytes = 0)) AND (upto IS NULL OR size_bytes <= upto) GROUP BY 1, 2")
def snp27_histogram(t):
    rows = t("extractions").where("language is not null")
    place = F.lit(len(BUCKETS))
    for k, end in reversed(list(enumerate(BUCKETS))):
        place = F.when(F.col("size_bytes") <= end, k).otherwise(place)
    counts = rows.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    names = rows.sparkSession.createDataFrame([(k, end) for k, end in enumerate([*BUCKETS, None])], "place int, upto int")
    return names.join(counts, "place", "left").select("place", "upto", F.coalesce("n", F.lit(0)).alias("n"))


@query("sch1", """SELECT 'snapshot status' AS rule, count(*) FILTER (WHERE status NOT IN ('pending', 'in_progress', 'completed')) AS violations FROM snapshots UNION ALL SELECT 'one completed attempt', count(*) FROM (SELECT 1 FROM snapshots WHERE status = 'completed' GROUP BY repository_id, commit_sha HAVING count(*) > 1) q
    UNION ALL SELECT 'unique file path', count(*) FROM (SELECT 1 FROM (SELECT snapshot_id, path FROM files UNION ALL SELECT snapshot_id, path FROM files WHERE id % 50 = 0) f GROUP BY snapshot_id, path HAVING count(*) > 1) q UNION ALL SELECT 'extraction without file', count(*) FROM extractions e WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.id = e.file_id AND f.id % 40 <> 0)""")
def sch1_audit(t):
    files = t("files").select("id", "snapshot_id", "path")
    rules = {
        "snapshot status": outside(t("snapshots"), "status", STATES[:3]),
        "one completed attempt": repeated(t("snapshots").where("status = 'completed'"), ATTEMPT),
        "unique file path": repeated(files.unionByName(files.where("id % 50 = 0")), ["snapshot_id", "path"]),
        "extraction without file": dangling(t("extractions"), "file_id", files.where("id % 40 <> 0"), "id"),
    }
    return reduce(DataFrame.unionByName, (rows.select(F.lit(rule).alias("rule"), "violations") for rule, rows in rules.items()))


def outside(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return rows.agg(F.count_if(~F.col(column).isin(*allowed)).alias("violations"))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("violations"))


def dangling(rows: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    return rows.join(target.select(F.col(key).alias(column)), column, "left_anti").agg(F.count(F.lit(1)).alias("violations"))
