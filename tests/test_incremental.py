"""A kept graph equals a graph built anew, while files that have not changed are not scanned."""

import hashlib

from lithic.operators.graph import EDGE, build_from_text
from lithic.operators.incremental import KeptGraph

SCHEMA = "snapshot_id long, id long, path string, language string, text string, content_hash string"


def repository():
    files = {}
    for k in range(12):
        files[k] = (f"src/f{k}.ts", "typescript", f"import {{ g{k} }} from './f{(k + 1) % 12}';\nexport class C{k} extends C{(k + 5) % 12} {{ m{k}() {{ g{(k + 3) % 12}(); shared(); }} }}\nfunction g{k}() {{}}\n")
    files[20] = ("a/x/Tool.java", "java", "package x; import y.Helper; public class Tool extends Helper { void run() { help(); } }")
    files[21] = ("a/y/Helper.java", "java", "package y; public class Helper { void help() { } }")
    files[30] = ("README.md", None, "# nothing")
    return files


def frame(spark, files, hidden=()):
    """Files as a table; of those in ``hidden`` only the hash is right."""
    rows = [(1, k, path, language, "class Wrong { wrong() { wrong2() } }" if k in hidden else text, hashlib.sha256(text.encode()).hexdigest()) for k, (path, language, text) in files.items()]
    return spark.createDataFrame(rows, SCHEMA)


def same(spark, kept, files):
    columns = [c for c in EDGE if c != "file_id"]
    key = lambda rows: sorted(repr(tuple(r)) for r in rows.select(columns).collect())
    return key(kept.edges()) == key(build_from_text(frame(spark, files).drop("content_hash")))


def test_updates(spark, tmp_path):
    kept, files = KeptGraph(spark, str(tmp_path / "graph")), repository()
    assert kept.update(frame(spark, files)) == {"scanned": 15, "resolved": 15, "removed": 0}
    assert same(spark, kept, files)
    version = kept._store.latest()
    assert kept.update(frame(spark, files, hidden=files)) == {"scanned": 0, "resolved": 0, "removed": 0} and kept._store.latest() == version

    # one file's function goes: its caller is resolved again, nothing else is, and no other text is read
    files[3] = (files[3][0], "typescript", files[3][2].replace("function g3", "function other"))
    assert kept.update(frame(spark, files, hidden=set(files) - {3})) == {"scanned": 1, "resolved": 2, "removed": 0}
    assert same(spark, kept, files)

    # a file comes that many wait for, one goes, one moves: imports follow the paths
    files[40] = ("src/shared.ts", "typescript", "export function shared() { g1(); }")
    files[5] = ("src/deep/f5.ts", *files[5][1:])
    del files[21]
    done = kept.update(frame(spark, files, hidden=set(files) - {40, 5}))
    assert done["scanned"] == 2 and done["removed"] == 1 and done["resolved"] <= len(files)
    assert same(spark, kept, files)
    # another version of the scanner fits no checkpoint
    assert KeptGraph(spark, str(tmp_path / "graph"), "next").update(frame(spark, files))["scanned"] == len(files)
