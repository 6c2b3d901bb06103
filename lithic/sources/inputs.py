"""Source inputs: parsing of URLs and logins, batches, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic.registry import query

# ---- fixed values
BLOCKED = ["/settings", "/explore", "/topics", "/marketplace", "/features"]
MAX_SOURCES = 5
OWNER = r"\A[A-Za-z0-9](?:[A-Za-z0-9-]{0,38})\z"
NAME = r"\A[A-Za-z0-9._-]{1,100}\z"
SHA = r"\A[0-9a-f]{40}\z"


def normalize(raw: Column) -> Column:
    """An https URL without www, trailing slashes and .git."""
    value = F.trim(raw)
    value = F.when(F.rlike(value, F.lit("(?i)^https?://")), value).otherwise(F.concat(F.lit("https://"), value))
    for pattern, by in (("(?i)^http://", "https://"), (r"(?i)^https://www\.", "https://"), ("/+$", ""), (r"(?i)\.git$", "")):
        value = F.regexp_replace(value, pattern, by)
    return F.when(F.trim(raw) == "", "").otherwise(value)


def parse_source(rows: DataFrame, host: str) -> DataFrame:
    """rows(raw, ...) with login, kind, url and error; ``host`` is a pattern for accepted hosts."""
    raw = F.trim("raw")
    bare = ~F.contains(raw, F.lit("/")) & ~F.contains(raw, F.lit("."))
    parsed = rows.withColumn("_url", normalize(F.col("raw")))
    site, path = F.expr("try_parse_url(_url, 'HOST')"), F.coalesce(F.expr("try_parse_url(_url, 'PATH')"), F.lit(""))
    parsed = parsed.withColumns({"_host": F.lower(site), "_path": path}).withColumn("_parts", F.filter(F.split("_path", "/"), lambda p: p != ""))
    first, second, n = F.get("_parts", F.lit(0)), F.get("_parts", F.lit(1)), F.size("_parts")
    blocked = F.lit(False)
    for prefix in BLOCKED:
        blocked = blocked | F.startswith("_path", F.lit(prefix))
    error = F.when(raw == "", "VALIDATION_EMPTY").when(bare, None).when(F.col("_host").isNull() | ~F.rlike("_host", F.lit(rf"\A(?:{host})\z")) | (n == 0) | blocked, "VALIDATION_INVALID_URL")
    kind = F.when(bare, "user").when((first == "orgs") & (n > 1), "org").when(n >= 2, "repo").otherwise("user")
    login = F.when(bare, F.regexp_replace(raw, "^@", "")).when((first == "orgs") & (n > 1), second).otherwise(first)
    base = F.concat(F.lit("https://"), F.coalesce(F.when(bare, None).otherwise(F.col("_host")), F.lit("forge.example")), F.lit("/"))
    url = F.when(kind == "org", F.concat(base, F.lit("orgs/"), login)).when(kind == "repo", F.concat(base, login, F.lit("/"), second)).otherwise(F.concat(base, login))
    parsed = parsed.withColumn("error", error)
    ok = F.col("error").isNull()
    return parsed.withColumns({"login": F.when(ok, login), "kind": F.when(ok, kind), "url": F.when(ok, url)}).drop("_url", "_host", "_path", "_parts")


def source_id() -> Column:
    return F.when(F.col("kind") == "repo", F.lower("url")).otherwise(F.lower("login"))


def dedupe(parsed: DataFrame) -> DataFrame:
    """Which source of a batch is the first of its kind and which repeats it."""
    first = F.row_number().over(W.partitionBy("batch", source_id()).orderBy("ordinal")) == 1
    return parsed.withColumn("first", first)


HOST = r"[a-z0-9.-]+\.example\.(?:com|org|net)"
PARSED = rf"""(SELECT *, CASE WHEN kind = 'repo' THEN lower(url) ELSE lower(login) END AS sid FROM (SELECT page_id, batch, ordinal, raw, error, CASE WHEN error IS NULL THEN login END AS login, CASE WHEN error IS NULL THEN kind END AS kind,
  CASE WHEN error IS NULL THEN concat('https://', CASE WHEN bare THEN 'forge.example' ELSE host END, '/', CASE kind WHEN 'org' THEN 'orgs/' || login WHEN 'repo' THEN login || '/' || parts[2] ELSE login END) END AS url FROM (
  SELECT *, CASE WHEN r = '' THEN 'VALIDATION_EMPTY' WHEN bare THEN NULL WHEN NOT regexp_full_match(host, '[a-z0-9.-]+\.example\.(com|org|net)') OR len(parts) = 0 OR regexp_matches(path, '^/(settings|explore|topics|marketplace|features)') THEN 'VALIDATION_INVALID_URL' END AS error,
  CASE WHEN bare THEN 'user' WHEN parts[1] = 'orgs' AND len(parts) > 1 THEN 'org' WHEN len(parts) >= 2 THEN 'repo' ELSE 'user' END AS kind,
  CASE WHEN bare THEN regexp_replace(r, '^@', '') WHEN parts[1] = 'orgs' AND len(parts) > 1 THEN parts[2] ELSE parts[1] END AS login FROM (
  SELECT *, NOT contains(r, '/') AND NOT contains(r, '.') AS bare, list_filter(string_split(path, '/'), lambda p: p <> '') AS parts FROM (
  SELECT *, lower(regexp_extract(u, '^https://([^/?#:]*)', 1)) AS host, regexp_extract(u, '^https://[^/?#]*([^?#]*)', 1) AS path FROM (
  SELECT *, trim(raw) AS r, regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN regexp_matches(trim(raw), '(?i)^https?://') THEN trim(raw) ELSE 'https://' || trim(raw) END, '(?i)^http://', 'https://'), '(?i)^https://www\.', 'https://'), '/+$', ''), '(?i)\.git$', '') AS u FROM source_inputs
  ) a) b) c) d) e) p"""


@query("url1", r"""SELECT page_id, CASE WHEN trim(raw) = '' THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN regexp_matches(trim(raw), '(?i)^https?://') THEN trim(raw) ELSE 'https://' || trim(raw) END, '(?i)^http://', 'https://'), '(?i)^https://www\.', 'https://'), '/+$', ''), '(?i)\.git$', '') END AS url FROM source_inputs""")
def url1_normalize(t):
    return t("source_inputs").select("page_id", normalize(F.col("raw")).alias("url"))


def _parsed(t) -> DataFrame:
    return parse_source(t("source_inputs"), HOST)


@query("url2", f"SELECT page_id, login, kind, url, error FROM {PARSED}")
def url2_parse(t):
    return _parsed(t).select("page_id", "login", "kind", "url", "error")


@query("url3", f"SELECT page_id, login, row_number() OVER (PARTITION BY batch, sid ORDER BY ordinal) = 1 AS first FROM {PARSED} WHERE error IS NULL")
def url3_dedupe(t):
    return dedupe(_parsed(t).where("error is null")).select("page_id", "login", "first")


def batch_errors(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """The error of each batch: nothing given, or too many different sources."""
    given = rows.groupBy("batch").agg(F.count_if(F.trim("raw") != "").alias("given"))
    unique = parsed.where("error is null").groupBy("batch").agg(F.count_distinct(source_id()).alias("sources"))
    sources = F.coalesce("sources", F.lit(0))
    return given.join(unique, "batch", "left").select("batch", sources.alias("sources"), F.when(F.col("given") == 0, "VALIDATION_EMPTY").when(sources > MAX_SOURCES, "TOO_MANY_SOURCES").alias("error"))


@query("url4", f"""SELECT batch, count(DISTINCT sid) FILTER (WHERE error IS NULL) AS sources, CASE WHEN count(*) FILTER (WHERE trim(raw) <> '') = 0 THEN 'VALIDATION_EMPTY' WHEN count(DISTINCT sid) FILTER (WHERE error IS NULL) > 5 THEN 'TOO_MANY_SOURCES' END AS error FROM {PARSED} GROUP BY batch""")
def url4_validate_batch(t):
    return batch_errors(t("source_inputs"), _parsed(t))


def source_keys(parsed: DataFrame) -> DataFrame:
    """Key of each batch: its sources in order, joined by plus signs."""
    name = F.lower(F.when(F.col("kind") == "repo", F.regexp_replace("url", "^https://[^/]*/", "")).otherwise(F.col("login")))
    return parsed.where("error is null").groupBy("batch").agg(F.array_join(F.array_sort(F.collect_set(name)), "+").alias("source_key"))


@query("url5", f"SELECT batch, string_agg(k, '+' ORDER BY k) AS source_key FROM (SELECT DISTINCT batch, lower(CASE WHEN kind = 'repo' THEN regexp_replace(url, '^https://[^/]*/', '') ELSE login END) AS k FROM {PARSED} WHERE error IS NULL) q GROUP BY batch")
def url5_source_key(t):
    return source_keys(_parsed(t))


@query("url6", f"SELECT batch, bool_or(lower(login) = 'fr' OR (kind = 'repo' AND regexp_matches(lower(url), '^https://[^/]*/fr/'))) AS has_owner FROM {PARSED} WHERE error IS NULL GROUP BY batch")
def url6_default_owner(t):
    owned = (F.lower("login") == "fr") | ((F.col("kind") == "repo") & F.rlike(F.lower("url"), F.lit("^https://[^/]*/fr/")))
    return _parsed(t).where("error is null").groupBy("batch").agg(F.bool_or(owned).alias("has_owner"))


@query("url7", f"SELECT page_id, coalesce(error, CASE WHEN kind <> 'repo' THEN 'NOT_A_REPOSITORY' END) AS error FROM {PARSED} WHERE trim(raw) <> ''")
def url7_mode_rows(t):
    rows = _parsed(t).where(F.trim("raw") != "")
    return rows.select("page_id", F.coalesce("error", F.when(F.col("kind") != "repo", "NOT_A_REPOSITORY")).alias("error"))


@query("url8", f"SELECT page_id, 'forge' AS provider, login AS owner, regexp_extract(url, '([^/]*)$', 1) AS name, 'added' AS status FROM {PARSED} WHERE kind = 'repo'")
def url8_select(t):
    return _parsed(t).where("kind = 'repo'").select("page_id", F.lit("forge").alias("provider"), F.col("login").alias("owner"), F.element_at(F.split("url", "/"), -1).alias("name"), F.lit("added").alias("status"))


def valid_identity(owner: Column, name: Column) -> Column:
    return F.rlike(owner, F.lit(OWNER)) & F.rlike(name, F.lit(NAME)) & ~name.isin(".", "..")


_ID = "CASE id % 6 WHEN 0 THEN concat('-', source_login) WHEN 1 THEN concat(source_login, chr(10)) ELSE source_login END AS owner, CASE id % 5 WHEN 0 THEN '..' WHEN 1 THEN concat(name, ' x') WHEN 2 THEN repeat(name, 9) ELSE name END AS n"


@query("idn1", rf"SELECT id, regexp_full_match(owner, '[A-Za-z0-9][A-Za-z0-9-]{{0,38}}') AND regexp_full_match(n, '[A-Za-z0-9._-]{{1,100}}') AND n NOT IN ('.', '..') AS valid FROM (SELECT id, {_ID} FROM repos) q")
def idn1_valid(t):
    rows = t("repos").selectExpr("id", *_ID.replace("chr(", "char(").split(", CASE id % 5")[:1], "CASE id % 5" + _ID.split(", CASE id % 5")[1])
    return rows.select("id", valid_identity(F.col("owner"), F.col("n")).alias("valid"))


@query("idn2", "SELECT r.id, s.id AS matched FROM (SELECT id, upper(full_name) AS wanted FROM repos WHERE id % 2 = 0) r JOIN repos s ON lower(wanted) = lower(s.full_name) WHERE len(string_split(wanted, '/')) = 2")
def idn2_match(t):
    return match_names(t("repos").where("id % 2 = 0").select("id", F.upper("full_name").alias("wanted")), t("repos"))


def match_names(requests: DataFrame, repos: DataFrame) -> DataFrame:
    """Requests(id, wanted) of the form owner/name with the repository of that name in any case."""
    parts = F.split("wanted", "/")
    whole = requests.where((F.size(parts) == 2) & valid_identity(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    named = repos.select(F.col("id").alias("matched"), F.lower("full_name").alias("_name"))
    return whole.join(named, F.lower("wanted") == F.col("_name")).select("id", "matched")


@query("idn3", "SELECT id, regexp_full_match(commit_sha, '[0-9a-f]{40}') AS valid, regexp_full_match(substr(commit_sha, 1, 39), '[0-9a-f]{40}') AS short, concat('forge:r', repository_id, '/', left(commit_sha, 7)) AS repository_key, concat('https://forge.example/r', repository_id) AS url FROM snapshots")
def idn3_shapes(t):
    return t("snapshots").select(
        "id", F.rlike("commit_sha", F.lit(SHA)).alias("valid"), F.rlike(F.substring("commit_sha", 1, 39), F.lit(SHA)).alias("short"),
        F.concat(F.lit("forge:r"), "repository_id", F.lit("/"), F.left("commit_sha", F.lit(7))).alias("repository_key"), F.concat(F.lit("https://forge.example/r"), "repository_id").alias("url"),
    )
