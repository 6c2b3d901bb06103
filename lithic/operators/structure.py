"""Structure and composition of a snapshot: levels, pages, buckets, layout."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic.functions.formats import bytes_label, plural
from lithic.operators.symbols import _EXTRACTED, extraction_summary, file_details
from lithic.registry import query
from lithic.sources.paths import base_name, extension_of, plain_path, under

BUCKETS, NODES, SYMBOLS, PAGE = 8, 60, 200, 100


def latest_completed(snapshots: DataFrame) -> DataFrame:
    """Each repository's newest completed snapshot, else what its latest attempt says."""
    done = F.max(F.when(F.col("status") == "completed", F.struct("completed_at", "id"))).alias("done")
    last = F.max_by("status", F.struct("created_at", "id")).alias("last")
    state = F.when(F.col("done").isNotNull(), "completed").when(F.col("last").isin("pending", "in_progress"), "snapshot_in_progress").otherwise("no_snapshot")
    return snapshots.groupBy("repository_id").agg(done, last).select("repository_id", F.col("done.id").alias("snapshot_id"), state.alias("state"))


@query("rdm1", "WITH s AS (SELECT * FROM snapshots) SELECT repository_id, arg_max(id, (completed_at, id)) FILTER (WHERE status = 'completed') AS snapshot_id, CASE WHEN bool_or(status = 'completed') THEN 'completed' WHEN arg_max(status, (created_at, id)) IN ('pending', 'in_progress') THEN 'snapshot_in_progress' ELSE 'no_snapshot' END AS state FROM s GROUP BY 1")
def rdm1_latest(t):
    return latest_completed(t("snapshots"))


_LATEST = "(SELECT repository_id, arg_max(id, (completed_at, id)) FILTER (WHERE status = 'completed') AS snapshot_id, CASE WHEN bool_or(status = 'completed') THEN 'completed' WHEN arg_max(status, (created_at, id)) IN ('pending', 'in_progress') THEN 'snapshot_in_progress' ELSE 'no_snapshot' END AS state FROM snapshots GROUP BY 1)"


@query("rdm1_whole", f"SELECT * FROM {_LATEST} l")
def rdm1_whole(t):
    """``rdm1`` over all attempts."""
    return latest_completed(t("snapshots"))


def composition(files: DataFrame, languages: DataFrame) -> DataFrame:
    """Files and bytes of each bucket of a snapshot: language, else extension."""
    ext = extension_of(F.col("path"))
    key = F.coalesce("language", F.when(ext != "", F.concat(F.lit("."), ext)), F.lit("(no extension)"))
    joined = files.join(languages.select(F.col("file_id").alias("id"), "language"), "id", "left")
    return joined.groupBy("snapshot_id", key.alias("key")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


_COMPOSED = r"(SELECT f.snapshot_id, coalesce(e.language, CASE WHEN regexp_matches(f.path, '\.[^./]+$') THEN concat('.', lower(regexp_extract(f.path, '\.([^./]+)$', 1))) ELSE '(no extension)' END) AS key, count(*) AS files, sum(f.size_bytes)::BIGINT AS bytes FROM files f LEFT JOIN extractions e ON e.file_id = f.id GROUP BY 1, 2)"


@query("rdm2", f"SELECT * FROM {_COMPOSED} c")
def rdm2_composition(t):
    return composition(t("files"), t("extractions"))


def top_buckets(composed: DataFrame, most: int = BUCKETS) -> DataFrame:
    """The largest buckets of each snapshot; the rest in one."""
    k = F.row_number().over(W.partitionBy("snapshot_id").orderBy(F.desc("bytes"), F.desc("files"), "key"))
    kept = composed.withColumn("key", F.when(k <= most, F.col("key")).otherwise("other"))
    return kept.groupBy("snapshot_id", "key").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


_TOP = f"(SELECT snapshot_id, CASE WHEN k <= 8 THEN key ELSE 'other' END AS key, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY bytes DESC, files DESC, key) AS k FROM {_COMPOSED} c) q GROUP BY 1, 2)"


@query("rdm3", f"SELECT * FROM {_TOP} x")
def rdm3_top_buckets(t):
    return top_buckets(composition(t("files"), t("extractions")))


def overview(snapshots: DataFrame, files: DataFrame, directories: DataFrame, extractions: DataFrame, counts: DataFrame, most: int = BUCKETS) -> DataFrame:
    """One row a repository: its newest snapshot with totals, extraction state and leading buckets."""
    latest = latest_completed(snapshots)
    totals = files.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    folders = directories.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("directories"))
    extracted = extraction_summary(extractions, counts).select("snapshot_id", "extracted", "symbols")
    buckets = top_buckets(composition(files, extractions), most)
    listed = buckets.groupBy("snapshot_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("b"), "key"))), lambda x: x["key"]), "|").alias("buckets"))
    for part in (totals, folders, extracted, listed):
        latest = latest.join(part, "snapshot_id", "left")
    return latest.select("repository_id", "snapshot_id", "state", "files", "bytes", "directories", "extracted", "symbols", "buckets")


@query("rdm4", f"""WITH l AS (SELECT repository_id, arg_max(id, (completed_at, id)) FILTER (WHERE status = 'completed') AS snapshot_id, CASE WHEN bool_or(status = 'completed') THEN 'completed' WHEN arg_max(status, (created_at, id)) IN ('pending', 'in_progress') THEN 'snapshot_in_progress' ELSE 'no_snapshot' END AS state FROM snapshots GROUP BY 1)
    SELECT repository_id, l.snapshot_id, state, files, bytes, directories, extracted, symbols, buckets FROM l LEFT JOIN (SELECT snapshot_id, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY 1) f USING (snapshot_id) LEFT JOIN (SELECT snapshot_id, count(*) AS directories FROM directories GROUP BY 1) d USING (snapshot_id)
    LEFT JOIN (SELECT snapshot_id, extracted, symbols FROM {_EXTRACTED} x) e USING (snapshot_id) LEFT JOIN (SELECT snapshot_id, string_agg(key, '|' ORDER BY bytes DESC, key) AS buckets FROM {_TOP} x GROUP BY 1) b USING (snapshot_id)""")
def rdm4_overview(t):
    counts = t("text_lines").groupBy("file_id").agg(F.count(F.lit(1)).alias("symbols"))
    return overview(t("snapshots"), t("files"), t("directories"), t("extractions"), counts)


@query("rdm4_whole", f"""SELECT repository_id, l.snapshot_id, state, files, bytes, directories, extracted, symbols, buckets FROM {_LATEST} l LEFT JOIN (SELECT snapshot_id, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY 1) f USING (snapshot_id) LEFT JOIN (SELECT snapshot_id, count(*) AS directories FROM directories GROUP BY 1) d USING (snapshot_id)
    LEFT JOIN (SELECT snapshot_id, extracted, symbols FROM {_EXTRACTED} x) e USING (snapshot_id) LEFT JOIN (SELECT snapshot_id, string_agg(key, '|' ORDER BY bytes DESC, key) AS buckets FROM {_TOP} x GROUP BY 1) b USING (snapshot_id)""")
def rdm4_whole(t):
    """``rdm4`` over all attempts."""
    counts = t("text_lines").groupBy("file_id").agg(F.count(F.lit(1)).alias("symbols"))
    return overview(t("snapshots"), t("files"), t("directories"), t("extractions"), counts)


def child_directories(files: DataFrame, directory: str) -> DataFrame:
    """Next path parts under a directory of each snapshot with the files below them."""
    skip = len(directory) + 2 if directory else 1
    rest = F.substring("path", skip, 1 << 20)
    rows = files.where(under(F.col("path"), directory)).where(F.contains(rest, F.lit("/")))
    return rows.groupBy("snapshot_id", F.substring_index(rest, "/", 1).alias("name")).agg(F.count(F.lit(1)).alias("files"))


@query("rdm5", "SELECT snapshot_id, split_part(substr(path, 4), '/', 1) AS name, count(*) AS files FROM files WHERE starts_with(path, 'en/') AND contains(substr(path, 4), '/') GROUP BY 1, 2")
def rdm5_children(t):
    return child_directories(t("files"), "en")


@query("rdm6", "SELECT snapshot_id, split_part(path, '/', 2) AS name, CASE WHEN snapshot_id % 3 = 0 THEN NULL ELSE sum(n)::BIGINT END AS symbols FROM (SELECT f.snapshot_id, f.path, coalesce(s.n, 0) AS n FROM files f LEFT JOIN (SELECT file_id, count(*) AS n FROM text_lines GROUP BY 1) s ON s.file_id = f.id WHERE starts_with(f.path, 'en/')) q GROUP BY 1, 2")
def rdm6_symbol_counts(t):
    """Symbols below each child directory; null where the snapshot has no extraction."""
    extracted = t("extractions").where("snapshot_id % 3 <> 0").select("snapshot_id", F.lit(True).alias("tried")).distinct()
    counts = t("text_lines").groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("file_id", "id")
    rows = t("files").where(under(F.col("path"), "en")).join(counts, "id", "left")
    names = rows.groupBy("snapshot_id", F.substring_index(F.substring("path", 4, 1 << 20), "/", 1).alias("name")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return names.join(extracted, "snapshot_id", "left").select("snapshot_id", "name", F.when(F.col("tried"), F.col("n")).alias("symbols"))


def direct_files(files: DataFrame, extractions: DataFrame, counts: DataFrame, directory: str) -> DataFrame:
    rest = F.substring("path", len(directory) + 2 if directory else 1, 1 << 20)
    rows = files.where(under(F.col("path"), directory)).where(~F.contains(rest, F.lit("/")))
    return file_details(rows.select(F.col("id").alias("file_id"), "snapshot_id", "path", "size_bytes"), extractions, counts)


@query("rdm7", "SELECT f.id, coalesce(e.status, 'not_attempted') AS status, e.language, CASE WHEN e.status = 'extracted' THEN coalesce(n, 0) ELSE 0 END AS symbols FROM files f LEFT JOIN extractions e ON e.file_id = f.id LEFT JOIN (SELECT file_id, count(*) AS n FROM text_lines GROUP BY 1) s ON s.file_id = f.id WHERE regexp_full_match(f.path, 'en/m2/[^/]*')")
def rdm7_direct(t):
    counts = t("text_lines").groupBy("file_id").agg(F.count(F.lit(1)).alias("symbols"))
    return direct_files(t("files"), t("extractions"), counts, "en/m2").select(F.col("file_id").alias("id"), "status", "language", "symbols")


def level(files: DataFrame, directory: str) -> DataFrame:
    """Directories, then files, directly under a directory of each snapshot: kind, name, weight."""
    rest = F.substring("path", len(directory) + 2 if directory else 1, 1 << 20)
    folders = child_directories(files, directory).select("snapshot_id", F.lit("directory").alias("kind"), "name", F.col("files").alias("weight"))
    own = files.where(under(F.col("path"), directory)).where(~F.contains(rest, F.lit("/")))
    return folders.unionByName(own.select("snapshot_id", F.lit("file").alias("kind"), base_name(F.col("path")).alias("name"), F.col("size_bytes").alias("weight")))


def level_page(rows: DataFrame, offset: int, limit: int = PAGE) -> DataFrame:
    """Rows offset .. offset+limit of each level with the offset of the next page, null on the last, and whether there is one.

    The limit is put between 1 and ``PAGE``, the offset at 0 or more. Each task
    sends on only the first rows of a level; the rest is counted.
    """
    offset, end = max(0, offset), max(0, offset) + max(1, min(limit, PAGE))
    order = W.partitionBy("snapshot_id").orderBy("kind", "name")
    first = rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= end)
    totals = rows.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("total"))
    page = first.where(F.col("place") > offset).join(totals, "snapshot_id")
    return page.withColumns({"next_cursor": F.when(F.col("total") > end, end), "truncated": F.col("total") > end}).drop("total")


def structure_page(snapshots: DataFrame, files: DataFrame, directory: str, offset: int = 0, limit: int = PAGE) -> DataFrame:
    """A page of a directory of each completed snapshot; an unsafe path and an open snapshot have no rows."""
    path = plain_path(directory)
    done = snapshots.where("status = 'completed'").select(F.col("id").alias("snapshot_id")).distinct()
    own = files.join(done, "snapshot_id", "left_semi")
    return level_page(level(own if path is not None else own.where("false"), path or ""), offset, limit)


@query("rdm8_page", "WITH p AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY kind, name) AS place, count(*) OVER (PARTITION BY snapshot_id) AS total FROM (SELECT snapshot_id, 'directory' AS kind, split_part(path, '/', 2) AS name, count(*) AS weight FROM files WHERE regexp_matches(path, '^en/[^/]*/') GROUP BY 1, 3 UNION ALL SELECT snapshot_id, 'file', split_part(path, '/', 2), size_bytes FROM files WHERE regexp_full_match(path, 'en/[^/]*')) l WHERE snapshot_id IN (SELECT id FROM snapshots WHERE status = 'completed')) SELECT snapshot_id, kind, name, weight, place, CASE WHEN total > 5 THEN 5 END AS next_cursor, total > 5 AS truncated FROM p WHERE place > 2 AND place <= 5")
def rdm8_page(t):
    return structure_page(t("snapshots"), t("files"), "/en/", 2, 3)


_LEVEL = "(SELECT snapshot_id, 'directory' AS kind, split_part(path, '/', 2) AS name, count(*) AS weight FROM files WHERE regexp_matches(path, '^en/[^/]*/') GROUP BY 1, 3 UNION ALL SELECT snapshot_id, 'file', split_part(path, '/', 2), size_bytes FROM files WHERE regexp_full_match(path, 'en/[^/]*'))"


@query("rdm8", f"WITH p AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY kind, name) AS place, count(*) OVER (PARTITION BY snapshot_id) AS total FROM {_LEVEL} l) SELECT snapshot_id, kind, name, weight, place, CASE WHEN total > 5 THEN 5 END AS next_cursor FROM p WHERE place > 2 AND place <= 5")
def rdm8_structure(t):
    return level_page(level(t("files"), "en"), 2, 3).drop("truncated")


@query("rdm9", "SELECT file_id, name, start_line, k, n, n > 200 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_line) AS k, count(*) OVER (PARTITION BY file_id) AS n FROM text_lines) q WHERE k <= 200")
def rdm9_file_symbols(t):
    return file_symbols(t("text_lines")).select("file_id", "name", "start_line", "k", "n", "truncated")


@query("rdm9_whole", "SELECT file_id, name, start_line, k, n, n > 200 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_line) AS k, count(*) OVER (PARTITION BY file_id) AS n FROM text_lines) q WHERE k <= 200")
def rdm9_whole(t):
    """``rdm9`` over the lines of all files."""
    return file_symbols(t("text_lines")).select("file_id", "name", "start_line", "k", "n", "truncated")


def file_symbols(symbols: DataFrame, most: int = SYMBOLS) -> DataFrame:
    """The first symbols of each file by position with their true number; each task sends on only the first ones of a file."""
    k = F.row_number().over(W.partitionBy("file_id").orderBy("start_line")).cast("long")
    counts = symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return symbols.withColumn("k", k).where(F.col("k") <= most).join(counts, "file_id").withColumn("truncated", F.col("n") > most)


def failure_class(reason: Column) -> Column:
    has = lambda words: F.rlike(reason, F.lit(f"(?i){words}"))
    return F.when(reason.isNull(), None).when(has("exceeds size ceiling"), "too_large").when(has("syntax errors|malformed source"), "syntax_errors").when(has("decode|invalid utf|not valid utf|object missing"), "unreadable").otherwise("extraction_failed")


@query("rdm10", "SELECT file_id, CASE WHEN failure_reason IS NULL THEN NULL WHEN failure_reason ILIKE '%exceeds size ceiling%' THEN 'too_large' WHEN failure_reason ILIKE '%syntax errors%' THEN 'syntax_errors' WHEN failure_reason ILIKE '%decode%' OR failure_reason ILIKE '%not valid utf%' THEN 'unreadable' ELSE 'extraction_failed' END AS failure FROM extractions")
def rdm10_failure(t):
    return t("extractions").select("file_id", failure_class(F.col("failure_reason")).alias("failure"))


def symbols_state(status: Column, symbols: Column) -> Column:
    return F.when(status == "not_started", "not_extracted").when(status != "completed", "partial").when(symbols > 0, "available").otherwise("empty")


@query("rdm11", f"SELECT snapshot_id, CASE WHEN skipped + failed > 0 THEN 'partial' WHEN symbols > 0 THEN 'available' ELSE 'empty' END AS state FROM {_EXTRACTED} x")
def rdm11_state(t):
    counts = t("text_lines").groupBy("file_id").agg(F.count(F.lit(1)).alias("symbols"))
    status = F.when(F.col("skipped") + F.col("failed") > 0, "completed_partial").otherwise("completed")
    return extraction_summary(t("extractions"), counts).select("snapshot_id", symbols_state(status, F.col("symbols")).alias("state"))


def level_items(rows: DataFrame, text: str = "", kind: str | None = None) -> DataFrame:
    """Items of a level that match, with a line about each."""
    needle = text.strip().lower()
    if needle:
        rows = rows.where(F.contains(F.lower("name"), F.lit(needle)))
    if kind:
        rows = rows.where(F.col("kind") == kind)
    detail = F.when(F.col("kind") == "directory", plural(F.col("weight"), "file")).otherwise(bytes_label(F.col("weight")))
    return rows.withColumn("label", F.concat(F.when(F.col("kind") == "directory", "Directory ").otherwise("File "), "name", F.lit(", "), detail))


@query("rdm12", f"SELECT snapshot_id, name, concat('Directory ', name, ', ', weight, CASE WHEN weight = 1 THEN ' file' ELSE ' files' END) AS label FROM {_LEVEL} l WHERE kind = 'directory' AND contains(lower(name), 'm')")
def rdm12_items(t):
    return level_items(level(t("files"), "en"), " M ", "directory").select("snapshot_id", "name", "label")


def overflow(rows: DataFrame, most: int = NODES) -> DataFrame:
    """What a level shows and how many of each kind it hides.

    All rows that fit, else all but one slot for each kind that overflows. Each
    task sends on only its first rows of a level; the rest is counted by kind.
    """
    most = max(2, most)
    kinds = rows.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "directory").alias("folders"), F.count_if(F.col("kind") == "file").alias("files"))
    both = (F.col("folders") > most - 2) & (F.col("n") > F.col("folders"))
    kinds = kinds.withColumn("keep", F.when(F.col("n") <= most, F.col("n")).when(both, most - 2).otherwise(most - 1))
    order = F.row_number().over(W.partitionBy("snapshot_id").orderBy("kind", F.desc("weight"), "name"))
    first = rows.withColumn("place", order.cast("long")).where(F.col("place") <= most)
    shown = first.join(kinds, "snapshot_id").where("place <= keep")
    folder = F.col("kind") == "directory"
    # folders come first, so those shown are the least of their number and the slots
    folders = F.least("folders", "keep")
    hidden = F.when(folder, F.col("folders") - folders).otherwise(F.col("files") - (F.col("keep") - folders))
    return shown.withColumn("hidden", hidden).drop("n", "folders", "files")


_FLAT = "(SELECT snapshot_id, CASE WHEN id % 3 = 0 THEN 'directory' ELSE 'file' END AS kind, path AS name, size_bytes AS weight FROM files)"
_KEPT = f"(SELECT *, count(*) FILTER (WHERE place > keep) OVER (PARTITION BY snapshot_id, kind) AS hidden FROM (SELECT *, CASE WHEN n <= 60 THEN n WHEN d > 58 AND n > d THEN 58 ELSE 59 END AS keep FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY kind, weight DESC, name) AS place, count(*) OVER (PARTITION BY snapshot_id) AS n, count(*) FILTER (WHERE kind = 'directory') OVER (PARTITION BY snapshot_id) AS d FROM {_FLAT} f) a) b)"


def _flat(t) -> DataFrame:
    return t("files").select("snapshot_id", F.when(F.col("id") % 3 == 0, "directory").otherwise("file").alias("kind"), F.col("path").alias("name"), F.col("size_bytes").alias("weight"))


@query("rdm13", f"SELECT snapshot_id, kind, name, place, hidden FROM {_KEPT} k WHERE place <= keep")
def rdm13_overflow(t):
    return overflow(_flat(t)).select("snapshot_id", "kind", "name", "place", "hidden")


def layout(shown: DataFrame, width: float = 800, height: float = 600) -> DataFrame:
    """Places and radii of the shown items on a sunflower spiral."""
    own = W.partitionBy("snapshot_id")
    kinds = F.max(F.when((F.col("kind") == "directory") & (F.col("hidden") > 0), 1).otherwise(0)).over(own) + F.max(F.when((F.col("kind") == "file") & (F.col("hidden") > 0), 1).otherwise(0)).over(own)
    slots = F.count(F.lit(1)).over(own) + kinds
    spacing = min(width, height) / 2 * 0.92 / F.sqrt(slots)
    most = F.least(F.lit(28.0), spacing * 0.45)
    least = F.greatest(F.lit(4.0), most * 0.35)
    top = F.max("weight").over(W.partitionBy("snapshot_id", "kind"))
    share = F.when(top > 0, F.log1p(F.col("weight")) / F.log1p(top)).otherwise(0.0)
    base = least + (most - least) * share
    at = F.col("place") - 1
    radius, angle = spacing * F.sqrt(at + 0.5), at * (pi * (3 - sqrt(5)))
    round2 = lambda c: F.floor(c * 100 + 0.5) / 100
    return shown.select("snapshot_id", "kind", "name", round2(width / 2 + radius * F.cos(angle)).alias("x"), round2(height / 2 + radius * F.sin(angle)).alias("y"), round2(F.when(F.col("kind") == "file", F.greatest(F.lit(3.0), base * 0.75)).otherwise(base)).alias("r"))


@query("rdm14", f"""WITH k AS (SELECT * FROM {_KEPT} k WHERE place <= keep), s AS (SELECT *, 300 * 0.92 / sqrt(count(*) OVER (PARTITION BY snapshot_id) + max(CASE WHEN kind = 'directory' AND hidden > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY snapshot_id) + max(CASE WHEN kind = 'file' AND hidden > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY snapshot_id)) AS spacing, max(weight) OVER (PARTITION BY snapshot_id, kind) AS top FROM k),
    r AS (SELECT *, least(28.0, spacing * 0.45) AS most, greatest(4.0, least(28.0, spacing * 0.45) * 0.35) AS small FROM s), b AS (SELECT *, small + (most - small) * CASE WHEN top > 0 THEN ln(1 + weight) / ln(1 + top) ELSE 0 END AS base FROM r)
    SELECT snapshot_id, kind, name, floor((400 + spacing * sqrt(place - 0.5) * cos((place - 1) * (pi() * (3 - sqrt(5))))) * 100 + 0.5) / 100 AS x, floor((300 + spacing * sqrt(place - 0.5) * sin((place - 1) * (pi() * (3 - sqrt(5))))) * 100 + 0.5) / 100 AS y,
    floor(CASE WHEN kind = 'file' THEN greatest(3.0, base * 0.75) ELSE base END * 100 + 0.5) / 100 AS r FROM b""")
def rdm14_layout(t):
    return layout(overflow(_flat(t)))
