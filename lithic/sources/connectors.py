"""Reading API records, archives, change lists, contents and caches; writing exports."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.registry import query
from lithic.saved import new_path
from lithic.sources.store import Store

API = "id long, name string, full_name string, html_url string, description string, language string, topics array<string>, stargazers_count long, forks_count long, license struct<spdx_id:string>, fork boolean, archived boolean, pushed_at string"


def from_api(records: DataFrame, login: Column, kind: str = "user") -> DataFrame:
    """Catalogue rows of API records(json)."""
    r = records.select(F.from_json("json", API).alias("r"), login.alias("source_login"))
    return r.select(
        "r.id", "r.name", "r.full_name", "r.html_url", "r.description", "r.language", F.coalesce("r.topics", F.array().cast("array<string>")).alias("topics"), F.col("r.stargazers_count").alias("stars"),
        F.col("r.forks_count").alias("forks"), F.col("r.license.spdx_id").alias("license"), "r.fork", "r.archived", "r.pushed_at", "source_login", F.lit(kind).alias("source_kind"),
    )


def to_api(repos: DataFrame) -> DataFrame:
    """API records of catalogue rows: the inverse, for round trips."""
    topics = F.when(F.size("topics") > 0, F.col("topics"))
    license_ = F.when(F.col("id") % 4 != 0, F.struct(F.lit("MIT").alias("spdx_id")))
    record = F.struct("id", "name", "full_name", "html_url", "description", "language", topics.alias("topics"), F.col("stars").alias("stargazers_count"), F.col("forks").alias("forks_count"), license_.alias("license"), "fork", "archived", "pushed_at")
    return repos.select(F.to_json(record).alias("json"), "source_login")


@query("src1", "SELECT id, full_name, description, language, array_to_string(topics, '|') AS topics, stars, forks, CASE WHEN id % 4 <> 0 THEN 'MIT' END AS license, fork, archived, pushed_at, source_login, 'user' AS source_kind FROM repos")
def src1_api(t):
    rows = from_api(to_api(t("repos")), F.col("source_login"))
    return rows.select("id", "full_name", "description", "language", F.array_join("topics", "|").alias("topics"), "stars", "forks", "license", "fork", "archived", "pushed_at", "source_login", "source_kind")


#: bytes of members that a task gathers before it sends them
_SEND = 8 << 20


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("archive", pa.string()), ("path", pa.string()), ("size_bytes", pa.int64()), ("content", pa.binary())])
    for batch in batches:
        for name, raw in zip(batch.column(0), batch.column(1), strict=True):
            rows: list[tuple] = []
            held = 0
            with tarfile.open(fileobj=pa.BufferReader(raw.as_buffer()), mode="r|*") as archive:  # one pass, without a copy of the archive
                for member in archive:
                    if member.isfile():
                        content = archive.extractfile(member).read()
                        rows.append((name.as_py(), member.name, len(content), content))
                        held += len(content)
                        if held >= _SEND:
                            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def scan_archives(archives: DataFrame) -> DataFrame:
    """One row for every regular file of archives(path, content): as ``spark.read.format("binaryFile")`` gives them."""
    return archives.select("path", "content").mapInArrow(_members, "archive string, path string, size_bytes long, content binary")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raws = []
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out = io.BytesIO()
            with tarfile.open(fileobj=out, mode="w:gz") as archive:
                folder = tarfile.TarInfo("root-0123abc/")
                folder.type = tarfile.DIRTYPE
                archive.addfile(folder)
                member = tarfile.TarInfo(f"root-0123abc/{path}")
                content = (text or "").encode()
                member.size = len(content)
                archive.addfile(member, io.BytesIO(content))
            raws.append(out.getvalue())
        yield pa.record_batch([batch.column(0), pa.array(raws, pa.binary())], names=["path", "content"])


@query("src2", "SELECT path, size_bytes, content_hash FROM files")
def src2_archives(t):
    """Every file packed into an archive of its own and read back."""
    archives = t("files").select("path", "text").mapInArrow(_packed, "path string, content binary")
    members = scan_archives(archives)
    return members.select(without_root(F.col("path"), F.lit("root"), F.lit("0123abc")).alias("path"), "size_bytes", F.sha2("content", 256).alias("content_hash"))


def without_root(path: Column, name: Column, sha: Column) -> Column:
    """The path without the folder that archives wrap it in."""
    root = F.concat(name, F.lit("-"), sha, F.lit("/"))
    return F.when(F.startswith(path, root), F.substring(path, F.length(root) + 1, F.length(path))).otherwise(path)


@query("src3", "SELECT id, CASE WHEN id % 3 = 0 THEN path WHEN id % 3 = 1 THEN path ELSE concat('other-abc/', path) END AS path FROM files")
def src3_root(t):
    raw = F.when(F.col("id") % 3 == 0, F.concat(F.lit("repo-abc/"), "path")).when(F.col("id") % 3 == 1, F.col("path")).otherwise(F.concat(F.lit("other-abc/"), "path"))
    return t("files").select("id", without_root(raw, F.lit("repo"), F.lit("abc")).alias("path"))


def change_list(responses: DataFrame) -> DataFrame:
    """(path, change_type) of compare responses(json)."""
    files = F.from_json("json", "struct<files:array<struct<filename:string,status:string>>>")["files"]
    rows = responses.select(F.inline(files))
    return rows.select(F.col("filename").alias("path"), F.when(F.col("status").isin("added", "removed"), F.col("status")).otherwise("modified").alias("change_type"))


@query("src4", "SELECT path, CASE id % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'modified' END AS change_type FROM files")
def src4_changes(t):
    status = F.element_at(F.array(*map(F.lit, ("added", "removed", "changed", "renamed"))), (F.col("id") % 4 + 1).cast("int"))
    responses = t("files").groupBy("snapshot_id", (F.col("id") % 50).alias("page")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("path").alias("filename"), status.alias("status"))).alias("files"))).alias("json"))
    return change_list(responses)


def decode_contents(responses: DataFrame) -> DataFrame:
    """Bytes of contents responses(json); other encodings are left out."""
    r = responses.select(F.from_json("json", "path string, encoding string, content string").alias("r")).select("r.*")
    content = F.unbase64(F.regexp_replace("content", "\n", ""))
    return r.where("encoding = 'base64' and content is not null").select("path", content.alias("content"))


@query("src5", "SELECT path, size_bytes, content_hash FROM files WHERE id % 5 <> 0")
def src5_contents(t):
    lines = F.regexp_replace(F.base64(F.col("text").cast("binary")), "\r", "")
    record = F.struct("path", F.when(F.col("id") % 5 == 0, "none").otherwise("base64").alias("encoding"), F.regexp_replace(lines, "(.{60})", "$1\n").alias("content"))
    decoded = decode_contents(t("files").select(F.to_json(record).alias("json")))
    return decoded.select("path", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("content_hash"))


def normalised(rows: DataFrame) -> DataFrame:
    """Catalogue rows with the defaults of missing fields, as live ones have them."""
    defaults = {"topics": F.array().cast("array<string>"), "stars": F.lit(0), "forks": F.lit(0), "fork": F.lit(False), "archived": F.lit(False)}
    return rows.withColumns({c: F.coalesce(c, v) for c, v in defaults.items() if c in rows.columns})


def with_fallback(live: DataFrame, failed: DataFrame, bundled: DataFrame) -> DataFrame:
    """Live rows where the source answered, bundled rows, normalised again, where it failed; tagged."""
    good = live.join(failed.select("login").distinct(), live.source_login == F.col("login"), "left_anti").withColumn("origin", F.lit("live"))
    bad = normalised(bundled).join(failed.select("login").distinct(), bundled.source_login == F.col("login"), "left_semi").withColumn("origin", F.lit("fallback"))
    return good.unionByName(bad)


def load_state(configured: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: how many sources are asked for, and whether rows are not_loaded (none is), fallback (all failed) or live."""
    asked = configured.select("login").distinct().join(failed.select("login").distinct().withColumn("bad", F.lit(True)), "login", "left")
    n, bad = F.count(F.lit(1)), F.count_if(F.col("bad"))
    return asked.agg(n.alias("requested"), F.when(n == 0, "not_loaded").when(bad == n, "fallback").otherwise("live").alias("origin"))


@query("src6_state", "WITH c AS (SELECT DISTINCT source_login AS login FROM repos), f AS (SELECT DISTINCT login FROM source_outcomes WHERE failed) SELECT 'some' AS configured, count(*) AS requested, CASE WHEN count(*) = 0 THEN 'not_loaded' WHEN count(f.login) = count(*) THEN 'fallback' ELSE 'live' END AS origin FROM c LEFT JOIN f USING (login) UNION ALL SELECT 'failed', count(*), CASE WHEN count(*) = 0 THEN 'not_loaded' ELSE 'fallback' END FROM c JOIN f USING (login) UNION ALL SELECT 'none', 0, 'not_loaded'")
def src6_state(t):
    """The state for all sources, for those that failed and for an empty configuration."""
    asked, failed = t("repos").select(F.col("source_login").alias("login")), t("source_outcomes").where("failed")
    parts = {"some": asked, "failed": asked.join(failed.select("login").distinct(), "login", "left_semi"), "none": asked.where("false")}
    return reduce(DataFrame.unionByName, (load_state(rows, failed).select(F.lit(name).alias("configured"), "requested", "origin") for name, rows in parts.items()))


@query("src6", "WITH f AS (SELECT DISTINCT login FROM source_outcomes WHERE failed) SELECT id, 'live' AS origin FROM repos WHERE source_login NOT IN (SELECT login FROM f) UNION ALL SELECT id, 'fallback' FROM repos WHERE source_login IN (SELECT login FROM f) AND id % 2 = 0")
def src6_fallback(t):
    return with_fallback(t("repos"), t("source_outcomes").where("failed"), t("repos").where("id % 2 = 0")).select("id", "origin")


def initial_sources(settings: DataFrame, default: list[str]) -> DataFrame:
    """Owners in settings(id, json); anything but a JSON array gives the default."""
    value = F.try_parse_json("json")
    is_array = F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), F.lit(False))
    items = F.when(is_array, F.try_variant_get(value, "$", "array<variant>"))
    own = F.filter(items, lambda v: (F.schema_of_variant(F.try_variant_get(v, "$.type", "variant")) == "STRING") & (F.try_variant_get(v, "$.type", "string").isin("user", "org", "repo")) & (F.schema_of_variant(F.try_variant_get(v, "$.owner", "variant")) == "STRING"))
    owners = F.transform(own, lambda v: F.try_variant_get(v, "$.owner", "string"))
    return settings.select("id", F.when(is_array, owners).otherwise(F.array(*map(F.lit, default))).alias("owners"))


@query("src7", """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'default' WHEN 2 THEN concat('u', user_id) ELSE '' END AS owners FROM events""")
def src7_initial(t):
    k, owner = F.col("event_id") % 4, F.concat(F.lit("u"), "user_id")
    good = F.format_string('[{"type":"user","owner":"%s"},{"type":"user","owner":5},{"type":"team","owner":"x"}]', owner)
    raw = F.when(k == 0, "not json").when(k == 1, F.format_string('{"owner":"%s"}', owner)).when(k == 2, good).otherwise("[]")
    rows = initial_sources(t("events").select(F.col("event_id").alias("id"), raw.alias("json")), ["default"])
    return rows.select("id", F.array_join("owners", "+").alias("owners"))


@query("src8", "SELECT id, CASE WHEN id % 5 <> 0 THEN full_name END AS full_name FROM repos")
def src8_cache(t):
    cached = to_api(t("repos").withColumn("key", F.col("id"))).withColumn("id", F.get_json_object("json", "$.id").cast("long"))
    rows = cached.withColumn("json", F.when(F.col("id") % 5 == 0, F.substring("json", 1, 20)).otherwise(F.col("json")))
    whole = F.when(F.try_parse_json("json").isNotNull(), F.from_json("json", API)["full_name"])
    return rows.select("id", whole.alias("full_name"))


def content_additions(files: DataFrame, store: DataFrame) -> DataFrame:
    """Content to append to a content-addressed store: each hash once, none that is there."""
    return files.select("content_hash", "size_bytes").dropDuplicates(["content_hash"]).join(store.select("content_hash"), "content_hash", "left_anti")


@query("snk1", "SELECT DISTINCT content_hash, size_bytes FROM files WHERE content_hash NOT IN (SELECT content_hash FROM files WHERE id % 4 = 0)")
def snk1_append(t):
    """What a second write adds to a store that has a fourth of the files."""
    store = Store(t.spark, new_path(t.spark, "contents"), "content_hash")
    files = t("files").select("content_hash", "size_bytes")
    first = store.append_new(t("files").where("id % 4 = 0").select(files.columns))
    added = store.read(store.append_new(files))
    return added.join(store.read(first), "content_hash", "left_anti")


def export_sources(default: str, host: str, urls: list[str] | None = None) -> Column:
    """The sources that an export of ``source_key`` names: those given, else the default owner's, else each part of the key."""
    page = lambda login: F.concat(F.lit(f"https://{host}/"), login)
    own = F.when(F.col("source_key") == default, F.array(page(F.col("source_key")))).otherwise(F.transform(F.split("source_key", "\\+"), page))
    return F.array(*map(F.lit, urls)) if urls else own


def export_headers(repos: DataFrame, default: str, host: str = "forge.example", urls: list[str] | None = None) -> DataFrame:
    """One row for each source key: its sources and number of rows."""
    counts = repos.groupBy(F.col("source_login").alias("source_key")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("source_key", (F.col("source_key") == default).alias("is_default"), F.array_join(export_sources(default, host, urls), ",").alias("sources"), "n")


def write_export(repos: DataFrame, path: str, default: str, host: str = "forge.example", urls: list[str] | None = None) -> None:
    """JSON lines of all rows in a folder for each source key, and the headers beside them.

    However many rows a key has, they are written by many tasks. Nothing to
    export is an error.
    """
    if repos.isEmpty():
        raise ValueError("there is nothing to export")
    repos.withColumn("source_key", F.col("source_login")).write.partitionBy("source_key").json(f"{path}/rows")
    export_headers(repos, default, host, urls).write.json(f"{path}/headers")


@query("snk2_headers", "SELECT source_login AS source_key, source_login = 'owner7' AS is_default, concat('https://forge.example/', source_login) AS sources, count(*) AS n FROM repos GROUP BY source_login")
def snk2_headers(t):
    """Headers as they are read back from an export."""
    path = new_path(t.spark, "export")
    write_export(t("repos").select("id", "full_name", "stars", "source_login"), path, "owner7")
    return t.spark.read.schema("source_key string, is_default boolean, sources string, n long").json(f"{path}/headers")


@query("snk2_rows", "SELECT source_login AS source_key, id, full_name, stars FROM repos")
def snk2_rows(t):
    """Rows as they are read back from an export."""
    path = new_path(t.spark, "export")
    write_export(t("repos").select("id", "full_name", "stars", "source_login"), path, "owner7")
    return t.spark.read.schema("id long, full_name string, stars long, source_key string").json(f"{path}/rows").select("source_key", "id", "full_name", "stars")


def export_envelopes(repos: DataFrame, default: str) -> DataFrame:
    """One JSON document for each source key, for keys whose rows fit one row of a table; ``write_export`` has no such limit."""
    row = F.to_json(F.struct("id", "full_name", "stars"))
    grouped = repos.groupBy(F.col("source_login").alias("source_key")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("id", row.alias("row")))).alias("rows"))
    return grouped.select("source_key", (F.col("source_key") == default).alias("is_default"), F.array_join(F.split("source_key", "\\+"), ",").alias("sources"), "n", F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit("]")).alias("payload"))


@query("snk2", """SELECT source_login AS source_key, source_login = 'owner7' AS is_default, source_login AS sources, count(*) AS n, concat('[', string_agg(concat('{"id":', id, ',"full_name":"', full_name, '","stars":', stars, '}'), ',' ORDER BY id), ']') AS payload FROM repos GROUP BY source_login""")
def snk2_export(t):
    return export_envelopes(t("repos"), "owner7")


def replace_by_source(spark: SparkSession, rows: DataFrame, path: str) -> int:
    """Replace the stored rows of every source key in ``rows`` at once; other keys stay. The number of the new version."""
    return Store(spark, path, "source_key").replace(rows)


def with_source(rows: DataFrame, host: str = "forge.example") -> DataFrame:
    """Each row with the source that it comes from, derived again: login, kind and url."""
    owner = F.substring_index("full_name", "/", 1)
    login = F.coalesce("source_login", F.when(owner != "", owner), F.lit("unknown"))
    kind = F.col("source_kind") if "source_kind" in rows.columns else F.lit(None)
    url = F.col("source_url") if "source_url" in rows.columns else F.lit(None)
    return rows.withColumns({"source_login": login, "source_kind": F.coalesce(kind, F.lit("user")), "source_url": F.coalesce(url, F.concat(F.lit(f"https://{host}/"), login))})


@query("snk3", "SELECT id, concat('k', id % 5) AS source_key, CASE WHEN id % 5 = 3 THEN stars + 1 ELSE stars END AS stars, coalesce(CASE WHEN id % 4 = 0 THEN NULL ELSE source_login END, split_part(full_name, '/', 1)) AS source_login, 'user' AS source_kind FROM repos WHERE NOT (id % 5 = 3 AND id % 2 = 0)")
def snk3_replace(t):
    """A store of five keys in which one key's rows are replaced by half of them."""
    rows = t("repos").select("id", "full_name", "stars", F.when(F.col("id") % 4 != 0, F.col("source_login")).alias("source_login"), F.concat(F.lit("k"), F.col("id") % 5).alias("source_key"))
    path, rows = new_path(t.spark, "cache"), with_source(rows)
    replace_by_source(t.spark, rows, path)
    replace_by_source(t.spark, rows.where("id % 5 = 3 and id % 2 <> 0").withColumn("stars", F.col("stars") + 1), path)
    return Store(t.spark, path, "source_key").read().select("id", "source_key", "stars", "source_login", "source_kind")


def fresh(rows: DataFrame, as_of: Column, ttl_ms: int = 900_000) -> DataFrame:
    """Cached rows(fetched_at in ms, expires_at in ms or null) that still count."""
    return rows.where(F.coalesce(F.col("expires_at") > as_of, as_of - F.col("fetched_at") <= ttl_ms))


@query("snk4", "SELECT id FROM (SELECT id, created_at, CASE WHEN id % 2 = 0 THEN created_at + 86400000 END AS expires_at, (SELECT max(created_at) FROM snapshots) AS now FROM snapshots) q WHERE CASE WHEN expires_at IS NOT NULL THEN expires_at > now ELSE now - created_at <= 900000000 END")
def snk4_fresh(t):
    rows = t("snapshots").select("id", F.col("created_at").alias("fetched_at"), F.when(F.col("id") % 2 == 0, F.col("created_at") + 86_400_000).alias("expires_at"))
    now = rows.agg(F.max("fetched_at").alias("now"))
    return fresh(rows.crossJoin(F.broadcast(now)), F.col("now"), 900_000_000).select("id")  # one row
