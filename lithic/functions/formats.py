"""Labels of numbers, dates, sizes and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lithic.registry import query


def compact_number(value: Column) -> Column:
    """1234 -> 1.2K, with at most one decimal and none when it is 0."""
    scaled = lambda unit, letter: F.concat(F.regexp_replace(F.format_string("%.1f", F.round(value / unit, 1)), r"\.0$", ""), F.lit(letter))
    return F.when(value < 1000, value.cast("string")).when(F.round(value / 1000, 1) < 1000, scaled(1000, "K")).when(F.round(value / 1_000_000, 1) < 1000, scaled(1_000_000, "M")).otherwise(scaled(1_000_000_000, "B"))


def date_label(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "MMM d, yyyy"), F.lit("Unknown"))


def bytes_label(value: Column) -> Column:
    label = F.when(value.isNull() | (value < 0), "unknown size").when(value < 1024, F.concat(value.cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        scaled = value / 1024**power
        text = F.when(scaled < 10, F.format_string("%.1f", F.floor(scaled * 10 + 0.5) / 10)).otherwise(F.floor(scaled + 0.5).cast("string"))
        text = F.concat(text, F.lit(" " + unit))
        label = label.when(scaled < 1024, text) if unit != "TB" else label.otherwise(text)
    return label


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))


def positive_int(text: Column, default: int) -> tuple[Column, Column]:
    """(value, valid) of a setting: blank or below 1 gives the default, other text is not valid."""
    trimmed = F.trim(text)
    number = trimmed.try_cast("int")
    return F.when(text.isNull() | (trimmed == "") | (number < 1), default).otherwise(number), text.isNull() | (trimmed == "") | number.isNotNull()


@query("fmt1", """SELECT l_orderkey, l_linenumber, v, CASE WHEN v < 1000 THEN v::VARCHAR WHEN round(v / 1000, 1) < 1000 THEN regexp_replace(format('{:.1f}', round(v / 1000, 1)), '\\.0$', '') || 'K'
    WHEN round(v / 1000000, 1) < 1000 THEN regexp_replace(format('{:.1f}', round(v / 1000000, 1)), '\\.0$', '') || 'M' ELSE regexp_replace(format('{:.1f}', round(v / 1000000000, 1)), '\\.0$', '') || 'B' END AS label
    FROM (SELECT l_orderkey, l_linenumber, l_partkey * l_suppkey * CASE WHEN l_orderkey % 3 = 0 THEN 997 ELSE 1 END AS v FROM lineitem) q""")
def fmt1_compact(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * F.col("l_suppkey") * F.when(F.col("l_orderkey") % 3 == 0, 997).otherwise(1)).alias("v"))
    return rows.withColumn("label", compact_number(F.col("v")))


@query("fmt2", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'Unknown' ELSE strftime(o_orderdate, '%b %-d, %Y') END AS label, strftime(o_orderdate, '%Y%m%d') AS stamp FROM orders")
def fmt2_date(t):
    day = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate"))
    return t("orders").select("o_orderkey", date_label(day).alias("label"), F.date_format("o_orderdate", "yyyyMMdd").alias("stamp"))


@query("fmt3", """SELECT id, CASE WHEN v < 0 THEN 'unknown size' WHEN v < 1024 THEN v || ' B' WHEN v < 1048576 THEN CASE WHEN v / 1024 < 10 THEN format('{:.1f}', floor(v / 1024 * 10 + 0.5) / 10) ELSE CAST(floor(v / 1024 + 0.5) AS BIGINT)::VARCHAR END || ' KB'
    ELSE CASE WHEN v / 1048576 < 10 THEN format('{:.1f}', floor(v / 1048576 * 10 + 0.5) / 10) ELSE CAST(floor(v / 1048576 + 0.5) AS BIGINT)::VARCHAR END || ' MB' END AS label FROM (SELECT id, size_bytes * CASE WHEN id % 7 = 0 THEN -1 WHEN id % 5 = 0 THEN 997 ELSE 1 END AS v FROM files) q""")
def fmt3_bytes(t):
    value = F.col("size_bytes") * F.when(F.col("id") % 7 == 0, -1).when(F.col("id") % 5 == 0, 997).otherwise(1)
    return t("files").select("id", bytes_label(value).alias("label"))


@query("fmt4", "SELECT id, concat(id % 3, ' ', CASE WHEN id % 3 = 1 THEN 'file' ELSE 'files' END) AS n, concat(id % 2, ' ', CASE WHEN id % 2 = 1 THEN 'directory' ELSE 'directories' END) AS d, left(content_hash, 7) AS sha, regexp_extract(path, '^(.*)/', 1) AS dir FROM files")
def fmt4_labels(t):
    from lithic.sources.paths import directory_of

    return t("files").select("id", plural(F.col("id") % 3, "file").alias("n"), plural(F.col("id") % 2, "directory", "directories").alias("d"), F.left("content_hash", F.lit(7)).alias("sha"), directory_of(F.col("path")).alias("dir"))


@query("fmt5", """SELECT event_id, CASE WHEN trim(s) = '' OR try_cast(trim(s) AS INTEGER) < 1 THEN 5 ELSE try_cast(trim(s) AS INTEGER) END AS value, trim(s) = '' OR try_cast(trim(s) AS INTEGER) IS NOT NULL AS valid
    FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN concat(' ', event_id) WHEN 2 THEN concat('-', event_id) WHEN 3 THEN event_type ELSE '7' END AS s FROM events) q""")
def fmt5_setting(t):
    k = F.col("event_id")
    raw = F.when(k % 5 == 0, " ").when(k % 5 == 1, F.concat(F.lit(" "), k)).when(k % 5 == 2, F.concat(F.lit("-"), k)).when(k % 5 == 3, F.col("event_type")).otherwise("7")
    value, valid = positive_int(raw, 5)
    return t("events").select("event_id", value.alias("value"), valid.alias("valid"))
