"""Inventories laid out by (snapshot, path): what lies below a directory is a short range of few files.

Rows are dealt out by ranges and sorted, so the files of the layout do not
overlap and a large snapshot has several. An index beside them names the first
and the last row of each file. A lookup reads the index with its filter pushed
down, opens the files whose ranges meet the directory, and in them the row
groups and pages whose statistics do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.registry import query
from lithic.saved import new_path
from lithic.sources.paths import plain_path, under

#: bytes of a row group, and rows of a page of a column
GROUP, PAGE_ROWS = 8 << 20, 2_000
_KEY = ["snapshot_id", "path"]


def write_inventory(files: DataFrame, path: str, group: int = GROUP, page_rows: int = PAGE_ROWS) -> None:
    """``files``(snapshot_id, path, ...) under ``path`` with their index; rows without a snapshot or a path lie first and are in no directory."""
    rows = files.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)
    rows.write.option("parquet.block.size", str(group)).option("parquet.page.row.count.limit", str(page_rows)).parquet(f"{path}/rows")
    at = F.struct(*_KEY)
    stored = read_inventory(files.sparkSession, path, files.select(*_KEY).schema).dropna()
    ranges = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    flat = ranges.select("file", F.col("first.snapshot_id").alias("from_snapshot"), F.col("first.path").alias("from_path"), F.col("last.snapshot_id").alias("to_snapshot"), F.col("last.path").alias("to_path"), "n")
    flat.write.parquet(f"{path}/index")


def read_inventory(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """All rows of a layout; a filter on snapshot and path skips row groups."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{path}/rows")


def _meets(snapshot: int, directory: str) -> Column:
    """Files whose range has a part in the directory's: neither wholly before nor wholly behind it."""
    before = (F.col("to_snapshot") < snapshot) | ((F.col("to_snapshot") == snapshot) & (F.col("to_path") < f"{directory}/"))
    behind = (F.col("from_snapshot") > snapshot) | ((F.col("from_snapshot") == snapshot) & (F.col("from_path") >= f"{directory}0"))
    inside = (F.col("from_snapshot") <= snapshot) & (F.col("to_snapshot") >= snapshot)  # ranges that statistics of the index can tell apart
    return inside & ~before & ~behind if directory else inside


def files_below(spark: SparkSession, path: str, snapshot: int, directory: str = "") -> DataFrame:
    """The rows of one snapshot below a directory ("" for all); none for an unsafe path.

    The names of the files that hold them come to the driver: as many as the
    result fills, and at most two more.
    """
    where = plain_path(directory)
    schema = read_inventory(spark, path).schema
    if where is None:
        return spark.createDataFrame([], schema)
    found = [f"{path}/rows/{r["file"]}" for r in spark.read.parquet(f"{path}/index").where(_meets(snapshot, where)).select("file").collect()]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*found).where((F.col("snapshot_id") == snapshot) & F.col("path").isNotNull() & under(F.col("path"), where))


@query("pth3_layout", "SELECT snapshot_id, id, path FROM files WHERE starts_with(path, 'en/m3/')")
def pth3_layout(t):
    """A directory of every snapshot, read from a layout of all files."""
    path = new_path(t.spark, "inventory")
    write_inventory(t("files").select("snapshot_id", "path", "id", "size_bytes"), path)
    return read_inventory(t.spark, path).where(under(F.col("path"), "en/m3")).select("snapshot_id", "id", "path")


@query("pth3_lookup", "SELECT snapshot_id, id, path FROM files WHERE snapshot_id = (SELECT arg_max(snapshot_id, (n, snapshot_id)) FROM (SELECT snapshot_id, count(*) AS n FROM files GROUP BY 1) c) AND starts_with(path, 'en/')")
def pth3_lookup(t):
    """What lies below a directory in the snapshot of most files, found through the index of the layout."""
    path = new_path(t.spark, "inventory")
    write_inventory(t("files").select("snapshot_id", "path", "id", "size_bytes"), path)
    sizes = read_inventory(t.spark, path).groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max_by("snapshot_id", F.struct("n", "snapshot_id"))).first()[0]
    return files_below(t.spark, path, largest if largest is not None else 0, "en").select("snapshot_id", "id", "path")
