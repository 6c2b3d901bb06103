"""Edges by either end: pages with a cursor, and what a lookup reads."""

import pytest

from lithic.operators.edge_store import one_reference, page, pages, read_edges, write_edges

BUCKETS = 8


@pytest.fixture(scope="module")
def edges():
    hub = [(1, "CALLS", f"f{k % 7}", "hub", f"{k * 7919 % 1000:04}", "AMBIGUOUS" if k % 5 == 0 else "RESOLVED", ["a", "b"] if k % 5 == 0 else None) for k in range(1000)]
    return hub + [(2, "IMPORTS", "hub", f"t{k}", f"i{k}", "RESOLVED", None) for k in range(3)] + [(1, "CALLS", "lone", None, "u1", "UNKNOWN", None)]


@pytest.fixture(scope="module")
def stored(spark, edges, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges") / "store")
    write_edges(spark.createDataFrame(edges, "snapshot_id long, type string, source string, target string, key string, state string, candidates array<string>"), path, BUCKETS)
    return path


def test_a_cursor_goes_through_all_edges_once(spark, edges, stored):
    seen, after, turns = [], None, 0
    while turns == 0 or after:
        rows, after = page(spark, stored, 1, "hub", "in", after=after, limit=300, buckets=BUCKETS)
        seen += [r.key for r in rows]
        turns += 1
    assert turns == 4 and seen == sorted(e[4] for e in edges if e[3] == "hub")
    assert [page(spark, stored, s, ref, side, kind, buckets=BUCKETS)[1] for s, ref, side, kind in ((1, "lone", "in", None), (2, "hub", "out", "CALLS"), (9, "none", "out", None))] == [None] * 3
    assert [len(page(spark, stored, 2, "hub", "out", kind, buckets=BUCKETS)[0]) for kind in (None, "IMPORTS", "CALLS")] == [3, 3, 0]
    rows, _ = page(spark, stored, 1, "hub", "in", limit=5, buckets=BUCKETS)
    assert all((r.candidates == ["a", "b"]) == (r.state == "AMBIGUOUS") for r in rows)


def test_exact_pages_have_no_next(spark, stored):
    rows, after = page(spark, stored, 1, "hub", "in", limit=1000, buckets=BUCKETS)
    assert len(rows) == 1000 and after is None


def test_a_lookup_reads_one_bucket_of_one_side(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    rows = one_reference(spark, stored, 1, "hub", "in", None, "0500", BUCKETS)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1] and "GreaterThan(key,0500)" in plan and "EqualTo(ref,hub)" in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "(side#" in plan and plan.count("(bucket#") and rows.count() == 499


def test_pages_of_many(spark, edges, stored):
    wanted = spark.createDataFrame([(1, "hub", None), (1, "hub", "0900"), (1, "f3", None), (2, "hub", None), (3, "hub", None)], "snapshot_id long, ref string, after string")
    found = pages(read_edges(spark, stored), wanted, limit=120, buckets=BUCKETS).collect()
    keys = lambda snapshot, ref, side: sorted(e[4] for e in edges if e[0] == snapshot and e[3 if side == "in" else 2] == ref)
    into = sorted((r.key, r.next) for r in found if (r.snapshot_id, r.ref, r.side) == (1, "hub", "in"))
    first = keys(1, "hub", "in")
    assert into == sorted([(k, first[119]) for k in first[:120]] + [(k, None) for k in first if k > "0900"], key=lambda x: (x[0], x[1] or ""))
    assert sorted(r.key for r in found if r.ref == "f3") == keys(1, "f3", "out")[:120]
    assert sorted(r.key for r in found if r.snapshot_id == 2) == keys(2, "hub", "out") and not [r for r in found if r.snapshot_id == 3]
