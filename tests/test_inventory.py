"""Layout of inventories: the right rows, and how few are read for them."""

import pytest
from pyspark.sql import functions as F

from lithic.operators.structure import child_directories
from lithic.sources.inventory import files_below, read_inventory, write_inventory
from lithic.sources.paths import under

ROWS = 200_000


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Snapshot 1 holds nine tenths of the files, the others the rest."""
    path = str(tmp_path_factory.mktemp("inventory") / "layout")
    k = F.col("id")
    name = F.concat(F.lit("d"), k % 40, F.lit("/e"), (k / 40).cast("long") % 25, F.lit("/f"), k)
    files = spark.range(ROWS).select(F.when(k % 10 > 0, 1).otherwise(2 + k % 7).cast("long").alias("snapshot_id"), name.alias("path"), "id")
    odd = spark.createDataFrame([(1, "d3-x/e", -1), (1, "d3", -2), (1, "d30", -3), (None, "d3/e1/lost", -4), (1, None, -5), (1, "d3/e1/f", -6), (1, "d3/e1/f", -6)], "snapshot_id long, path string, id long")
    write_inventory(files.unionByName(odd), path, group=64 << 10, page_rows=500)
    return path


def scanned(rows):
    """Rows and files that the scan gave, once ``rows`` has run."""
    leaves = rows._jdf.queryExecution().executedPlan().collectLeaves()
    metrics = [leaves.apply(k).metrics() for k in range(leaves.size())]
    return [sum(m.apply(name).value() for m in metrics) for name in ("numOutputRows", "numFiles")]


@pytest.mark.parametrize(("snapshot", "directory"), [(1, "d3"), (1, "/d3/e1/"), (3, "d12"), (1, ""), (8, ""), (5, "none"), (99, "d3")])
def test_same_rows_as_a_whole_scan(spark, stored, snapshot, directory):
    plain = directory.strip("/")
    expected = read_inventory(spark, stored).where((F.col("snapshot_id") == snapshot) & F.col("path").isNotNull() & F.startswith(F.coalesce("path", F.lit("")), F.lit(f"{plain}/" if plain else "")))
    ids = lambda rows: sorted(r.id for r in rows.select("id").collect())
    assert ids(files_below(spark, stored, snapshot, directory)) == ids(expected)


def test_unsafe_directories_have_no_rows(spark, stored):
    assert [files_below(spark, stored, 1, d).count() for d in ("a/../b", "a//b", "./a", "a\\b", "\x01")] == [0] * 5


def test_a_directory_reads_its_range(spark, stored):
    rows = files_below(spark, stored, 1, "d3/e1").select("id")
    found = len(rows.collect())
    read, files = scanned(rows)
    assert found == 202 and read <= found + 2 * 500 and files <= 2
    # without the index all files are opened, but only pages around the directory are read
    rows = read_inventory(spark, stored).where((F.col("snapshot_id") == 1) & under(F.col("path"), "d3/e1")).select("id")
    assert len(rows.collect()) == found and scanned(rows)[0] <= found + 8 * 500


def test_files_do_not_overlap(spark, stored):
    index = sorted(spark.read.parquet(f"{stored}/index").collect(), key=lambda r: (r.from_snapshot, r.from_path))
    assert len(index) > 1 and sum(r.n for r in index) == ROWS + 5
    assert all((a.to_snapshot, a.to_path) <= (b.from_snapshot, b.from_path) for a, b in zip(index, index[1:], strict=False))


def test_an_empty_inventory(spark, tmp_path):
    write_inventory(spark.createDataFrame([], "snapshot_id long, path string, id long"), str(tmp_path / "none"))
    assert files_below(spark, str(tmp_path / "none"), 1, "a").count() == 0


def test_levels_of_a_lookup(spark, stored):
    """The structure reports take a lookup like any inventory."""
    found = {r.name: r.files for r in child_directories(files_below(spark, stored, 1, "d3"), "d3").collect()}
    # the twice written row counts twice
    assert found == {f"e{k}": 200 + 2 * (k == 1) for k in range(25)}
