"""Queries over whole tables reach rows that a subset of ids leaves out."""

from lithic import catalog
from lithic.operators.structure import latest_completed
from lithic.views import Tables


def test_newest_attempts_of_all_repositories(spark, small):
    attempts = Tables(spark, small)("snapshots").select("id", "repository_id", "status", "completed_at").collect()
    newest = {}
    for r in attempts:
        if r.status == "completed":
            newest[r.repository_id] = max(newest.get(r.repository_id, (0, -1)), (r.completed_at, r.id))
    assert any(k >= 40 for _, k in newest.values())
    for name in ("rdm1_whole", "rdm4_whole"):
        found = {r.repository_id: r.snapshot_id for r in catalog.QUERIES[name](spark, small).collect()}
        assert found == {r.repository_id: newest.get(r.repository_id, (None, None))[1] for r in attempts}


def test_symbols_of_all_files(spark, small):
    files = Tables(spark, small)("text_lines").select("file_id").distinct()
    assert catalog.QUERIES["rdm9_whole"](spark, small).select("file_id").distinct().count() == files.count()


def test_open_and_missing_states(spark):
    rows = [(1, 1, "completed", 1, 2), (50, 1, "completed", 3, 4), (51, 1, "failed", 5, None), (60, 2, "failed", 1, None), (61, 2, "pending", 2, None), (70, 3, "in_progress", 1, None), (71, 3, "failed", 2, None)]
    frame = spark.createDataFrame(rows, "id long, repository_id long, status string, created_at long, completed_at long")
    found = {r.repository_id: (r.snapshot_id, r.state) for r in latest_completed(frame).collect()}
    assert found == {1: (50, "completed"), 2: (None, "snapshot_in_progress"), 3: (None, "no_snapshot")}
