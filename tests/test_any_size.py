"""Operators on inputs beyond the small tables: whole orders, long chains, late events, damaged stores."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lithic.operators.explore import nearest_in_group
from lithic.operators.ordering import number_rows
from lithic.operators.structure import level_page, overflow, structure_page
from lithic.operators.symbols import batch_units, checked_parents, symbol_tree
from lithic.sources.connectors import export_sources, load_state, write_export
from lithic.streaming import jobs


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_rows_are_numbered_whatever_their_number(spark, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = spark.range(1_000_000).select("id", F.crc32(F.col("id").cast("string")).alias("h"), F.repeat(F.lit("wide "), 20).alias("w"), (F.col("id") % 3 * (F.col("id") % 2)).alias("g"))
        found = number_rows(rows, [F.desc("h"), F.asc("id")]).select("id", "h", "position", "w").toPandas()
        expected = found.sort_values(["h", "id"], ascending=[False, True])
        assert len(found) == 1_000_000 and (expected.position.to_numpy() == range(1, 1_000_001)).all() and found.w.str.len().eq(100).all()
        own = number_rows(rows.drop("w"), [F.asc("h"), F.asc("id")], "k", ["g"]).toPandas().sort_values(["g", "h", "id"])
        assert len(own) == 1_000_000 and (own.groupby("g").cumcount() + 1 == own.k).all()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_long_chains_and_circles(spark):
    rows = [(k, k - 1 if k else None) for k in range(10_000)]
    rows += [(20_000, 20_002), (20_001, 20_000), (20_002, 20_001), (20_003, 20_002)]  # a circle and a node below it
    rows += [(30_000, 30_000), (30_001, 30_000), (30_002, 99_999)]
    found = {r.node: (r.root, r.depth) for r in symbol_tree(spark.createDataFrame(rows, "node long, parent long")).collect()}
    assert all(found[k] == (0, k) for k in range(10_000))
    assert all(found[k] == (None, None) for k in range(20_000, 20_004))
    assert found[30_000] == (30_000, 0) and found[30_001] == (30_000, 1) and found[30_002] == (30_002, 0)


class Held:
    """State variables of one key in plain Python."""

    def __init__(self):
        self.value, self.map = None, {}
        self.exists, self.get, self.update = lambda: self.value is not None, lambda: self.value, lambda v: setattr(self, "value", v)
        self.containsKey, self.updateValue, self.removeKey = lambda k: k in self.map, lambda k, v: self.map.__setitem__(k, v), lambda k: self.map.pop(k)
        self.keys, self.iterator = lambda: list(self.map), lambda: iter(self.map.items())

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, value):
        return self


def fold(batches):
    processor, out = jobs.JobFold(), None
    processor.init(Held())
    for rows in batches:
        frame = pd.DataFrame(rows, columns=["event_id", "event", "cursor_at", "reason"])
        out = next(processor.handleInputRows((1, 2), iter([frame]), None)).iloc[0].tolist()
    return out


def test_late_and_repeated_events():
    events = [(1, "pending", 10, None), (2, "failure", 20, "a"), (3, "failure", 30, "b"), (5, "completed", 50, None), (6, "failure", 60, "c")]
    expected = [1, 2, "completed", 2, 60, "b"]
    assert fold([[e] for e in events]) == expected
    assert fold([[events[4]], [events[1], events[1]], [events[3]], [events[0], events[2]], [events[1]]]) == expected
    assert fold([events[:2], events[:2]]) == [1, 2, "retrying", 1, 20, "a"]


def test_replay_in_another_order(spark, tmp_path):
    write = jobs.replay_safe_sink(["k"], str(tmp_path / "out"))
    rows = [(1, "a", 1), (1, "c", 0), (1, "b", 5), (2, "x", 1)]
    stored = []
    for order in (rows, rows[::-1]):
        write(spark.createDataFrame(order, "k long, v string, n long").repartition(3), 7)
        stored.append(sorted(spark.read.parquet(str(tmp_path / "out")).select("k", "v", "n").collect()))
    assert stored[0] == stored[1] and [tuple(r) for r in stored[0]] == [(1, "c", 0), (2, "x", 1)]


def test_nearest_against_brute_force(spark):
    rows = [(k, k % 3 * (k % 2), [float((k * 7919 + j * 104_729) % 97) for j in range(6)]) for k in range(400)] + [(1000 + k, 9, [1.0, 2.0]) for k in range(5)]
    found = {r.id: (r.nearest, r.d) for r in nearest_in_group(spark.createDataFrame(rows, "id long, group long, v array<float>")).collect()}
    for k, group, v in rows:
        d, other = min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), o) for o, own, w in rows if own == group and o != k)
        assert found[k] == (other, d)


def test_overflow_and_pages(spark):
    rows = [(1, "directory", f"d{k:02}", k) for k in range(9)] + [(1, "file", f"f{k:02}", k) for k in range(6)] + [(2, "file", "one", 1)]
    frame = spark.createDataFrame(rows, "snapshot_id long, kind string, name string, weight long")
    shown = {m: [(r.kind, r.hidden) for r in overflow(frame, m).where("snapshot_id = 1").orderBy("place").collect()] for m in (5, 10, 15)}
    assert shown[5] == [("directory", 6)] * 3  # two slots say what is hidden
    assert shown[10] == [("directory", 1)] * 8 or shown[10] == [("directory", 0)] * 9
    assert len(shown[15]) == 15 and {h for _, h in shown[15]} == {0}
    page = level_page(frame, -3, 10**6)
    assert page.count() == 16 and page.where("truncated or next_cursor is not null").count() == 0
    assert {(r.place, r.next_cursor, r.truncated) for r in level_page(frame, 0, 0).where("snapshot_id = 1").collect()} == {(1, 1, True)}
    files = spark.createDataFrame([(1, 5, "a/b", 1), (2, 6, "a/c", 1)], "snapshot_id long, id long, path string, size_bytes long")
    snapshots = spark.createDataFrame([(1, "completed"), (2, "pending")], "id long, status string")
    assert [r["name"] for r in structure_page(snapshots, files, "a/").collect()] == ["b"]
    assert structure_page(snapshots, files, "a/../a").count() == 0


def test_units_of_a_large_snapshot(spark):
    files = spark.range(10_000).select(F.lit(1).cast("long").alias("snapshot_id"), (F.col("id") * 3).alias("id"))
    units = batch_units(files, 50).orderBy("unit").collect()
    assert len(units) == 200 and all(u.files == 50 and u.first_id == 150 * k for k, u in enumerate(units))
    assert units[-1].next_cursor is None and units[0].next_cursor == 147


def test_unresolved_parents_are_an_error(spark):
    frame = lambda rows: spark.createDataFrame(rows, "file_id long, id long, symbol_key string, parent_key string")
    assert {r.id: r.parent_id for r in checked_parents(frame([(1, 1, "a", None), (1, 2, "b", "a"), (2, 3, "a", None)])).collect()} == {1: None, 2: 1, 3: None}
    with pytest.raises(ValueError, match="'a' of 'b'"):
        checked_parents(frame([(1, 1, "a", None), (2, 2, "b", "a")]))


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "o"), (2, "a+b")], "id long, source_login string")
    with pytest.raises(ValueError, match="nothing"):
        write_export(rows.where("false"), str(tmp_path / "none"), "o")
    keys = rows.select(F.col("source_login").alias("source_key"))
    assert [r[0] for r in keys.select(export_sources("o", "h")).collect()] == [["https://h/o"], ["https://h/a", "https://h/b"]]
    assert [r[0] for r in keys.select(export_sources("o", "h", ["u"])).collect()] == [["u"], ["u"]]
    logins = spark.createDataFrame([("o",), ("p",)], "login string")
    assert [load_state(a, b).first().origin for a, b in ((logins, logins), (logins, logins.limit(1)), (logins.limit(0), logins))] == ["fallback", "live", "not_loaded"]


def test_states_of_sources(spark):
    from lithic.operators.catalogue import connected_sources

    repos = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "source_login string")
    failures = spark.createDataFrame([("b",), ("c",), ("c",)], "login string")
    assert {tuple(r) for r in connected_sources(repos, failures).collect()} == {("a", 2, "connected"), ("b", 1, "degraded"), ("c", 0, "error")}


def test_size_ceiling(spark):
    from lithic.operators.symbols import gate

    rows = [("a.ts", 10, b"x", True), ("a.ts", 11, b"x", True), ("a.md", 1, b"x", True), ("a.js", 1, None, True), ("a.js", 1, b"\xff", True), ("A.JAVA", 1, b"x", False)]
    found = gate(spark.createDataFrame(rows, "path string, size_bytes long, content binary, parsed boolean"), 10).select("status", "failure_reason").collect()
    assert [tuple(r) for r in found] == [
        ("extracted", None), ("skipped_unsupported", "exceeds size ceiling (11 > 10 bytes)"), ("skipped_unsupported", None), ("failed", "object missing"), ("failed", "not valid UTF-8"), ("failed", "parse produced syntax errors"),
    ]


def test_jobs_end_to_end(spark, small):
    from lithic.plans import jobs as plans
    from lithic.views import Tables

    t = Tables(spark, small)
    assert plans.catalogue_job(t("repo_sources"), "owner7").count() > 0
    assert plans.overview_job(t).count() == t("snapshots").select("repository_id").distinct().count()
    edges = plans.graph_job(t)
    assert edges.count() == edges.select("snapshot_id", "type", "source", "key").count() > 0
    assert {r.violations for r in plans.audit_job(t).collect()} == {0}


def test_every_rule_of_the_schema_counts(spark, small):
    from lithic import catalog

    found = {r.rule: r.violations for r in catalog.QUERIES["sch1_all"](spark, small).collect()}
    assert len(found) == 25 and all(found.values()), found


def test_names_in_the_order_of_a_language(spark):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(["b", "A", "a-c", "ab", "é", "B", "e", "f"])], "id long, name string")
    found = number_rows(rows, [F.collate("name", "UNICODE"), F.asc("id")])
    assert [r["name"] for r in found.orderBy("position").collect()] == ["A", "a-c", "ab", "b", "B", "e", "é", "f"]
