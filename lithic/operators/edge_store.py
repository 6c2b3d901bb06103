"""Edges laid out for lookups by either end, in pages.

Every edge is written twice, once under its source and once under its target, in
buckets of (snapshot, reference), sorted by (snapshot, reference, key). A lookup
reads one bucket of one side, and in it the row groups whose statistics hold the
reference; a page begins behind a key and says with which key the next begins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic.saved import drop_saved, save
from lithic.sieve import may_match

PAGE = 100
BUCKETS = 64
_SIDES = {"out": "source", "in": "target"}


def bucket_of(snapshot: Column, ref: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(snapshot.cast("long"), ref), F.lit(buckets)).cast("int")


def write_edges(edges: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """``edges`` in both directions under ``path``; edges without an end are left out on that side."""
    kept = ["snapshot_id", "type", "key", "state", "candidates"]
    # ranges are drawn from one reading and filled by another: what edges are made of is done once
    edges = save(edges.select("source", "target", *kept), "edges")
    sides = (edges.where(F.col(end).isNotNull()).select(F.lit(side).alias("side"), F.col(end).alias("ref"), *kept) for side, end in _SIDES.items())
    rows = reduce(DataFrame.unionByName, sides).withColumn("bucket", bucket_of(F.col("snapshot_id"), F.col("ref"), buckets))
    # a bucket with a hub is dealt out to several files by ranges of keys, each sorted
    spread = rows.repartitionByRange("side", "bucket", "snapshot_id", "ref", "key").sortWithinPartitions("side", "bucket", "snapshot_id", "ref", "key")
    spread.write.partitionBy("side", "bucket").option("parquet.block.size", str(8 << 20)).parquet(path)
    drop_saved(edges)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    schema = "ref string, snapshot_id long, type string, key string, state string, candidates array<string>, side string, bucket int"
    return spark.read.schema(schema).parquet(path)


def page(spark: SparkSession, path: str, snapshot: int, ref: str, side: str = "out", kind: str | None = None, after: str | None = None, limit: int = PAGE, buckets: int = BUCKETS) -> tuple[list, str | None]:
    """The edges of one reference behind the key ``after``, and the key to go on from (None at the end)."""
    rows = one_reference(spark, path, snapshot, ref, side, kind, after, buckets).orderBy("key").limit(limit + 1).collect()
    return rows[:limit], rows[limit - 1]["key"] if len(rows) > limit else None


def one_reference(spark: SparkSession, path: str, snapshot: int, ref: str, side: str, kind: str | None, after: str | None, buckets: int = BUCKETS) -> DataFrame:
    """What a page is taken from: filters that reach partitions and statistics."""
    bucket = spark.range(1).select(bucket_of(F.lit(snapshot), F.lit(ref), buckets)).first()[0]
    rows = read_edges(spark, path).where((F.col("side") == side) & (F.col("bucket") == bucket) & (F.col("snapshot_id") == snapshot) & (F.col("ref") == ref))
    rows = rows.where(F.col("type") == kind) if kind else rows
    rows = rows.where(F.col("key") > after) if after else rows
    return rows.select("key", "type", "state", F.when(F.col("state") == "AMBIGUOUS", F.col("candidates")).alias("candidates"))


def pages(edges: DataFrame, wanted: DataFrame, kind: str | None = None, limit: int = PAGE, buckets: int = BUCKETS) -> DataFrame:
    """The page of each wanted(snapshot_id, ref[, after]) on both sides of stored ``edges``: its rows, and ``next`` on every row of a page that is not the last."""
    after = F.col("after") if "after" in wanted.columns else F.lit(None).cast("string")
    asked = wanted.select(F.col("snapshot_id").cast("long").alias("snapshot_id"), "ref", after.alias("_after")).distinct().withColumn("bucket", bucket_of(F.col("snapshot_id"), F.col("ref"), buckets))
    rows = edges.where(F.col("type") == kind) if kind else edges
    rows = may_match(rows, ["snapshot_id", "ref"], asked).join(asked, ["bucket", "snapshot_id", "ref"]).where(F.col("_after").isNull() | (F.col("key") > F.col("_after")))
    by = W.partitionBy("snapshot_id", "ref", "side", "_after")
    first = rows.withColumn("k", F.row_number().over(by.orderBy("key"))).where(F.col("k") <= limit + 1)
    more = F.max(F.when(F.col("k") == limit, F.col("key"))).over(by)
    shown = first.withColumn("next", F.when(F.max("k").over(by) > limit, more)).where(F.col("k") <= limit)
    return shown.select("snapshot_id", "ref", "side", "key", "type", "state", F.when(F.col("state") == "AMBIGUOUS", F.col("candidates")).alias("candidates"), "next")
