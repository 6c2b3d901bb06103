"""Repository paths: safety, parts, and prefix ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lithic.registry import query


def safe_path(raw: Column) -> Column:
    """The path without outer slashes; null for an empty, dot or dot-dot part, a control character or a backslash."""
    path = F.regexp_replace(raw, r"^/+|/+$", "")
    parts = F.split(path, "/")
    bad = F.rlike(path, F.lit(r"[\x00-\x1F\\]")) | ((path != "") & F.exists(parts, lambda p: p.isin("", ".", "..")))
    return F.when(~bad, path)


def plain_path(raw: str) -> str | None:
    """``safe_path`` of one path on the driver: a parameter of a query."""
    path = raw.strip("/")
    parts = path.split("/") if path else []
    bad = any(c < " " or c == "\\" for c in path) or any(p in ("", ".", "..") for p in parts)
    return None if bad else path


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension_of(path: Column) -> Column:
    base = base_name(path)
    return F.when(F.contains(base, F.lit(".")), F.lower(F.substring_index(base, ".", -1))).otherwise("")


def directory_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def under(path: Column, directory: str) -> Column:
    """Paths below a directory as a range that a Parquet scan can use."""
    return (path >= directory + "/") & (path < directory + "0") if directory else F.lit(True)


_RAW = "CASE id % 8 WHEN 0 THEN concat('/', path, '/') WHEN 1 THEN replace(path, '/', '//') WHEN 2 THEN concat('./', path) WHEN 3 THEN concat(path, '/../x') WHEN 4 THEN replace(path, '/', chr(92)) WHEN 5 THEN concat(path, chr(9)) WHEN 6 THEN '' ELSE path END"


@query("pth1", f"""SELECT id, CASE WHEN regexp_matches(p, '[\\x00-\\x1F\\\\]') OR (p <> '' AND len(list_filter(string_split(p, '/'), lambda x: x IN ('', '.', '..'))) > 0) THEN NULL ELSE p END AS path FROM (SELECT id, regexp_replace({_RAW}, '^/+|/+$', '', 'g') AS p FROM files) q""")
def pth1_safe(t):
    raw = F.expr(_RAW.replace("chr(", "char("))
    return t("files").select("id", safe_path(raw).alias("path"))


@query("pth2", "SELECT id, base, CASE WHEN contains(base, '.') THEN lower(regexp_extract(base, '\\.([^.]*)$', 1)) ELSE '' END AS ext, regexp_extract(path, '^(.*)/', 1) AS dir FROM (SELECT id, path, regexp_extract(path, '([^/]*)$', 1) AS base FROM files) q")
def pth2_parts(t):
    path = F.col("path")
    return t("files").select("id", base_name(path).alias("base"), extension_of(path).alias("ext"), directory_of(path).alias("dir"))


@query("pth3", "SELECT id, path FROM files WHERE starts_with(path, 'en/m3/')")
def pth3_prefix(t):
    return t("files").where(under(F.col("path"), "en/m3")).select("id", "path")
