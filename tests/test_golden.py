"""Hand-made inputs with hand-derived results."""

import hashlib
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from lithic.functions.formats import bytes_label, compact_number
from lithic.functions.hashing import unit_hash
from lithic.operators import graph as g
from lithic.operators.catalogue import MESSAGES, message
from lithic.operators.ordering import number_rows
from lithic.operators.symbols import declarations, nest
from lithic.sources.connectors import initial_sources, replace_by_source, scan_archives, without_root
from lithic.sources.store import Store
from lithic.sources.inputs import parse_source, valid_identity
from lithic.sources.paths import extension_of, safe_path

TS = """import { b } from './util';
export class Widget extends Base implements Shown {
  draw(x: number) {
    helper("}");
  }
}
function helper(text) { return text; } // {
const arrow = (a) => a + 1;
"""
JAVA = """import com.acme.Tool;
public class Outer {
    class Inner {
        private int size(String a) {
            return 1;
        }
    }
}
interface Shown { }
"""


@pytest.fixture
def sources(spark):
    return spark.createDataFrame([(1, "typescript", TS), (2, "java", JAVA), (3, None, "class X {}")], "file_id long, language string, text string")


def test_declarations(sources):
    found = {(r.file_id, r.kind, r.name): (r.start_line, r.end_line) for r in declarations(sources).collect()}
    assert found == {
        (1, "class", "Widget"): (1, 5),
        (1, "method", "draw"): (2, 4),
        (1, "function", "helper"): (6, 6),
        (2, "class", "Outer"): (1, 7),
        (2, "class", "Inner"): (2, 6),
        (2, "method", "size"): (3, 5),
        (2, "interface", "Shown"): (8, 8),
    }


def test_nesting(spark):
    rows = [(1, 1, "A", 0, 9), (1, 2, "B", 1, 8), (1, 3, "c", 2, 3), (1, 4, "d", 20, 21), (2, 5, "c", 2, 3)]
    frame = spark.createDataFrame(rows, "file_id long, symbol long, name string, start_at long, end_at long")
    found = {r.symbol: (r.parent, r.qualified_name) for r in nest(frame).collect()}
    assert found == {1: (None, None), 2: (1, "A.B"), 3: (2, "A.B.c"), 4: (None, None), 5: (None, None)}


def test_facts(sources):
    found = {(r.file_id, r.line, r.type, r["name"]) for r in g.extract_facts(sources).collect()}
    assert {(1, 0, "IMPORTS", "./util"), (1, 1, "EXTENDS", "Base"), (1, 1, "IMPLEMENTS", "Shown"), (1, 1, "EXPORTS", "Widget"), (1, 3, "CALLS", "helper"), (2, 0, "IMPORTS", "com.acme.Tool")} <= found
    assert (1, 6, "CALLS", "helper") not in found


def test_import_candidates(spark):
    rows = [(1, "src/a/x.ts", "../b/y.js"), (2, "x.ts", "react"), (3, "src/x.ts", "."), (4, "x.ts", "../../y")]
    found = {}
    for r in g.import_candidates(spark.createDataFrame(rows, "id long, path string, spec string")).orderBy("id", "precedence").collect():
        found.setdefault(r.id, []).append(r.candidate)
    assert found[1][0] == "src/b/y.js" and "src/b/y.ts" in found[1] and found[1][-1] == "src/b/y.js/index.cts"
    assert 2 not in found and found[3][0] == "src" and "src/index.ts" in found[3] and found[4][0] == "y"


def test_name_resolution(spark):
    symbols = spark.createDataFrame(
        [(1, 1, "script", "a.ts", 0, "f", "function"), (1, 2, "script", "b.ts", 0, "g", "function"), (1, 2, "script", "b.ts", 5, "h", "method"), (1, 3, "script", "c.ts", 1, "h", "method"), (1, 4, "java", "D.java", 1, "g", "method"), (1, 4, "java", "D.java", 2, "k", "class")],
        "snapshot_id long, file_id long, family string, path string, start_line long, name string, kind string",
    )
    facts = spark.createDataFrame([(1, 1, 1, "script", "f"), (2, 1, 1, "script", "g"), (3, 1, 1, "script", "h"), (4, 2, 1, "script", "h"), (5, 1, 1, "script", "k"), (6, 1, 2, "script", "g")], "fact long, file_id long, snapshot_id long, family string, callee string")
    found = {r.fact: (r.state, r.target, r.candidates) for r in g.resolve_names(facts, symbols, ["function", "method"]).collect()}
    assert found == {1: ("RESOLVED", "a.ts#0", None), 2: ("RESOLVED", "b.ts#0", None), 3: ("AMBIGUOUS", None, ["b.ts#5", "c.ts#1"]), 4: ("RESOLVED", "b.ts#5", None), 5: ("UNKNOWN", None, None), 6: ("UNKNOWN", None, None)}


def test_broken_graph_is_seen(spark, small):
    from lithic.views import Tables

    t = Tables(spark, small)
    edges = g.build(t)
    broken = edges.withColumns(
        {
            "target": F.when(F.col("type") == "IMPORTS", "gone.ts").when(F.col("state") == "UNKNOWN", "nowhere").otherwise(F.col("target")),
            "target_kind": F.when(F.col("type") == "IMPORTS", "file").otherwise(F.col("target_kind")),
            "state": F.when((F.col("type") == "CONTAINS") & (F.crc32("source") % 5 == 0), "RESOLVED").otherwise(F.col("state")),
        }
    )
    seen = {r.rule: r.violations for r in g.invariants(broken, g._nested(t), t("files"), t("directories")).collect()}
    assert seen["open state with target"] > 0 and seen["dangling target file"] > 0 and seen["containment not extracted"] > 0 and seen["orphan directory"] == 0


def test_fingerprint_ignores_order(spark):
    rows = [(1, f"line {k}") for k in range(200)]
    first = g.fingerprints(spark.createDataFrame(rows, "snapshot_id long, line string")).collect()
    again = g.fingerprints(spark.createDataFrame(rows[::-1], "snapshot_id long, line string").repartition(3)).collect()
    other = g.fingerprints(spark.createDataFrame(rows[1:], "snapshot_id long, line string")).collect()
    assert first == again != other


def test_paths(spark):
    raw = ["", "/a/b/", "a//b", "a/./b", "../x", "a\\b", "a\x01", ".env", "a.", "archive.tar.gz", "a.b/c"]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(raw)], "k int, p string").select("k", safe_path(F.col("p")).alias("s"), extension_of(F.col("p")).alias("e")).orderBy("k").collect()
    assert [r.s for r in rows] == ["", "a/b", None, None, None, None, None, ".env", "a.", "archive.tar.gz", "a.b/c"]
    assert [r.e for r in rows][7:] == ["env", "", "gz", ""]


def test_sources(spark):
    raw = ["  ", "@Some", "forge.example/o/r.git", "http://www.forge.example/orgs/Acme/", "forge.example", "forge.example/topicsX", "other.example/a/b", "https://forge.example/solo"]
    rows = parse_source(spark.createDataFrame([(k, x) for k, x in enumerate(raw)], "k int, raw string"), r"forge\.example").orderBy("k").collect()
    assert [(r.kind, r.login, r.error) for r in rows] == [
        (None, None, "VALIDATION_EMPTY"), ("user", "Some", None), ("repo", "o", None), ("org", "Acme", None), (None, None, "VALIDATION_INVALID_URL"), (None, None, "VALIDATION_INVALID_URL"), (None, None, "VALIDATION_INVALID_URL"), ("user", "solo", None),
    ]
    assert rows[2].url == "https://forge.example/o/r"


def test_identity_does_not_end_at_a_line_feed(spark):
    rows = spark.createDataFrame([("a", "b\n"), ("a-b", "x.y"), ("-a", "x"), ("a", "..")], "o string, n string")
    assert [r[0] for r in rows.select(valid_identity(F.col("o"), F.col("n"))).collect()] == [False, True, False, False]


def test_archives(spark, tmp_path):
    out = io.BytesIO()
    long = "root-abc/" + "d/" * 80 + "f.txt"
    with tarfile.open(fileobj=out, mode="w:gz", format=tarfile.PAX_FORMAT) as archive:
        for name, kind, content in (("root-abc", tarfile.DIRTYPE, b""), (long, tarfile.REGTYPE, b"x"), ("root-abc/é", tarfile.REGTYPE, b""), ("root-abc/link", tarfile.SYMTYPE, b"")):
            member = tarfile.TarInfo(name)
            member.type, member.size, member.linkname = kind, len(content), "f"
            archive.addfile(member, io.BytesIO(content))
    (tmp_path / "one.tar.gz").write_bytes(out.getvalue())
    members = scan_archives(spark.read.format("binaryFile").load(str(tmp_path)))
    found = {r.p: r.size_bytes for r in members.select(without_root(F.col("path"), F.lit("root"), F.lit("abc")).alias("p"), "size_bytes").collect()}
    assert found == {"d/" * 80 + "f.txt": 1, "é": 0}


def test_initial_sources(spark):
    rows = [(1, "nope"), (2, "{}"), (3, '[{"type":"org","owner":"a"},{"type":"x","owner":"b"},{"type":"user","owner":5},7]'), (4, None)]
    found = {r.id: r.owners for r in initial_sources(spark.createDataFrame(rows, "id long, json string"), ["d"]).collect()}
    assert found == {1: ["d"], 2: ["d"], 3: ["a"], 4: ["d"]}


def test_replace_by_source(spark, tmp_path):
    path = str(tmp_path / "cache")
    frame = lambda rows: spark.createDataFrame(rows, "id long, source_key string")
    replace_by_source(spark, frame([(1, "a"), (2, "a"), (3, "b")]), path)
    replace_by_source(spark, frame([(4, "a")]), path)
    assert {(r.id, r.source_key) for r in Store(spark, path, "source_key").read().collect()} == {(4, "a"), (3, "b")}


def test_formats(spark):
    rows = spark.createDataFrame([(0,), (999,), (1234,), (999_950,), (1_000_000,), (-1,), (10_240,)], "v long").select(compact_number(F.col("v")), bytes_label(F.col("v"))).collect()
    assert [tuple(r) for r in rows][:5] == [("0", "0 B"), ("999", "999 B"), ("1.2K", "1.2 KB"), ("1M", "977 KB"), ("1M", "977 KB")]
    assert rows[5][1] == "unknown size" and rows[6][1] == "10 KB"


def test_unit_hash(spark):
    def plain(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h / 4294967295

    words = ["1:a", "hello", "x"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(unit_hash(F.col("w"))).collect()
    assert [r[0] for r in rows] == [plain(w) for w in words]


def test_number_rows(spark):
    rows = spark.range(1000).select(F.col("id"), F.crc32(F.col("id").cast("string")).alias("h")).repartition(5)
    found = {r.id: r.position for r in number_rows(rows, [F.asc("h"), F.asc("id")]).collect()}
    expected = sorted(rows.collect(), key=lambda r: (r.h, r.id))
    assert found == {r.id: k for k, r in enumerate(expected, 1)}


def test_messages(spark):
    row = spark.range(1).select(message(F.lit("PARTIAL_FAILURE"), {"ok": F.lit("3"), "fail": F.lit("1")}), message(F.lit("NONE"), {})).first()
    assert row[0] == "Loaded 3 source(s). 1 failed." and row[1] is None
    assert hashlib.sha256("".join(MESSAGES).encode()).hexdigest()
