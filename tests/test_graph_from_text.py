"""Small repositories of real shape: declarations, facts and the whole graph from their text, and rules that see every damage."""

import pytest
from pyspark.sql import functions as F

from lithic.operators import graph as g
from lithic.operators.code import scan
from lithic.operators.symbols import directory_chain

FILES = {
    "src/util.ts": ("typescript", 'export function helper(a: string) {\n  return a.trim();\n}\n\nexport const twice = (x: number) => {\n  return once(x) + once(x);\n};\nfunction once(x) { return x; }\nexport { once as single };\n'),
    "src/index.ts": ("typescript", "import { helper } from './util';\nimport type { Shown } from './types.js';\nimport React from 'react';\n// import nothing from './comment';\nconst text = \"import no from './string'\";\nexport default class Widget extends Base<Shown> implements Shown, Sized {\n  draw(x: number): void {\n    helper('}'); this.size(); missing();\n  }\n  async size({ a, b } = {}) { return twice(1); }\n}\nhelper('top');\n"),
    "src/types.ts": ("typescript", "export interface Shown extends Drawn, Sized {}\ninterface Drawn { draw(x: number): void }\nexport interface Sized {}\nexport class Base {}\n"),
    "src/min.js": ("javascript", "class A{m(){n()}}function n(){return o()}function o(){}const p=()=>n();module.exports={n};const q=require('./util');"),
    "a/com/acme/Tool.java": ("java", "package com.acme;\n\nimport com.acme.io.Reader;\nimport java.util.List;\n\npublic class Tool extends Reader implements Runnable {\n    private final Reader reader = new Reader();\n\n    public Tool(Reader reader) {\n        super(reader);\n    }\n\n    @Override\n    public void run() {\n        if (ready()) { read(); }\n    }\n\n    boolean ready() throws Exception { return true; }\n}\n"),
    "a/com/acme/io/Reader.java": ("java", "package com.acme.io;\n/* class Hidden { void gone() {} } */\npublic class Reader {\n    protected void read() { open(); }\n    static <T> void open() { }\n}\ninterface Closer { void close(); }\n"),
    "b/com/acme/io/Reader.java": ("java", "package com.acme.io;\npublic class Reader { void read() { } }\n"),
    "README.md": (None, "# class Nothing {}\n"),
}

SYMBOLS = {
    ("src/util.ts", "function", "helper", 0, 2), ("src/util.ts", "function", "once", 7, 7),
    ("src/index.ts", "class", "Widget", 5, 10), ("src/index.ts", "method", "draw", 6, 8), ("src/index.ts", "method", "size", 9, 9),
    ("src/types.ts", "interface", "Shown", 0, 0), ("src/types.ts", "interface", "Drawn", 1, 1), ("src/types.ts", "method", "draw", 1, 1), ("src/types.ts", "interface", "Sized", 2, 2), ("src/types.ts", "class", "Base", 3, 3),
    ("src/min.js", "class", "A", 0, 0), ("src/min.js", "method", "m", 0, 0), ("src/min.js", "function", "n", 0, 0), ("src/min.js", "function", "o", 0, 0),
    ("a/com/acme/Tool.java", "class", "Tool", 5, 18), ("a/com/acme/Tool.java", "method", "run", 13, 15), ("a/com/acme/Tool.java", "method", "ready", 17, 17),
    ("a/com/acme/io/Reader.java", "class", "Reader", 2, 5), ("a/com/acme/io/Reader.java", "method", "read", 3, 3), ("a/com/acme/io/Reader.java", "method", "open", 4, 4), ("a/com/acme/io/Reader.java", "interface", "Closer", 6, 6), ("a/com/acme/io/Reader.java", "method", "close", 6, 6),
    ("b/com/acme/io/Reader.java", "class", "Reader", 1, 1), ("b/com/acme/io/Reader.java", "method", "read", 1, 1),
}

#: type, source (file or name of symbol), name, state, target (file or name of symbol)
EDGES = {
    ("IMPORTS", "src/index.ts", "./util", "RESOLVED", "src/util.ts"), ("IMPORTS", "src/index.ts", "./types.js", "RESOLVED", "src/types.ts"), ("IMPORTS", "src/index.ts", "react", "UNKNOWN", None), ("CALLS", "src/min.js", "require", "UNKNOWN", None),
    ("IMPORTS", "a/com/acme/Tool.java", "com.acme.io.Reader", "AMBIGUOUS", None), ("IMPORTS", "a/com/acme/Tool.java", "java.util.List", "UNKNOWN", None),
    ("EXTENDS", "src/index.ts#Widget", "Base", "RESOLVED", "src/types.ts#Base"), ("IMPLEMENTS", "src/index.ts#Widget", "Shown", "RESOLVED", "src/types.ts#Shown"), ("IMPLEMENTS", "src/index.ts#Widget", "Sized", "RESOLVED", "src/types.ts#Sized"),
    ("EXTENDS", "src/types.ts#Shown", "Drawn", "RESOLVED", "src/types.ts#Drawn"), ("EXTENDS", "src/types.ts#Shown", "Sized", "RESOLVED", "src/types.ts#Sized"),
    ("EXTENDS", "a/com/acme/Tool.java#Tool", "Reader", "AMBIGUOUS", None), ("IMPLEMENTS", "a/com/acme/Tool.java#Tool", "Runnable", "UNKNOWN", None),
    ("CALLS", "src/index.ts#draw", "helper", "RESOLVED", "src/util.ts#helper"), ("CALLS", "src/index.ts#draw", "size", "RESOLVED", "src/index.ts#size"), ("CALLS", "src/index.ts#draw", "missing", "UNKNOWN", None), ("CALLS", "src/index.ts#size", "twice", "UNKNOWN", None), ("CALLS", "src/index.ts", "helper", "RESOLVED", "src/util.ts#helper"),
    ("CALLS", "src/util.ts#helper", "trim", "UNKNOWN", None), ("CALLS", "src/util.ts", "once", "RESOLVED", "src/util.ts#once"),
    ("CALLS", "src/min.js#m", "n", "RESOLVED", "src/min.js#n"), ("CALLS", "src/min.js#n", "o", "RESOLVED", "src/min.js#o"), ("CALLS", "src/min.js", "n", "RESOLVED", "src/min.js#n"),
    ("CALLS", "a/com/acme/Tool.java#run", "ready", "RESOLVED", "a/com/acme/Tool.java#ready"), ("CALLS", "a/com/acme/Tool.java#run", "read", "AMBIGUOUS", None), ("CALLS", "a/com/acme/io/Reader.java#read", "open", "RESOLVED", "a/com/acme/io/Reader.java#open"),
    ("EXPORTS", "src/util.ts", "helper", "RESOLVED", "src/util.ts#helper"), ("EXPORTS", "src/index.ts", "Widget", "RESOLVED", "src/index.ts#Widget"),
    ("EXPORTS", "src/types.ts", "Shown", "RESOLVED", "src/types.ts#Shown"), ("EXPORTS", "src/types.ts", "Sized", "RESOLVED", "src/types.ts#Sized"), ("EXPORTS", "src/types.ts", "Base", "RESOLVED", "src/types.ts#Base"),
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(1, k, path, language, text) for k, (path, (language, text)) in enumerate(FILES.items())]
    return spark.createDataFrame(rows, "snapshot_id long, id long, path string, language string, text string").repartition(3)


@pytest.fixture(scope="module")
def built(files):
    symbols, _ = g.symbols_and_facts(files)
    return symbols.cache(), g.build_from_text(files).cache()


def test_symbols(files, built):
    lines = {path: text.split("\n") for path, (_, text) in FILES.items()}
    assert lines
    found = set()
    for path, (language, text) in FILES.items():
        if language:
            for kind, name, at, end in scan(text, language)[0]:
                found.add((path, kind, name, text.count("\n", 0, at), text.count("\n", 0, end)))
    assert found == SYMBOLS
    assert {(r.path, r.kind, r["name"], r.start_line) for r in built[0].collect()} == {s[:4] for s in SYMBOLS}


def test_nesting(built):
    found = {(r.path, r["name"]): r.qualified_name for r in built[0].collect()}
    assert found["src/index.ts", "draw"] == "Widget.draw" and found["src/min.js", "m"] == "A.m" and found["src/util.ts", "once"] is None


def test_edges(built):
    symbols, edges = built
    names = {r.fact: f"{r.path}#{r['name']}" for r in symbols.collect()}
    found = {(r.type, names.get(r.source, r.source), r["name"], r.state, names.get(r.target, r.target)) for r in edges.where("type <> 'CONTAINS'").collect()}
    assert found == EDGES
    candidates = {r["name"]: len(r.candidates) for r in edges.where("state = 'AMBIGUOUS'").collect()}
    assert candidates == {"com.acme.io.Reader": 2, "Reader": 2, "read": 2}
    assert edges.count() == edges.select("snapshot_id", "key").distinct().count()


def test_sound_and_complete(files, built):
    symbols, edges = built
    directories = directory_chain(files)
    assert {r.rule: r.violations for r in g.invariants(edges, symbols, files, directories).collect()} == dict.fromkeys(g.RULES, 0)
    assert {r.kind: (r.violations, r.nodes) for r in g.completeness(edges, symbols, files, directories).collect()} == {"symbol": (0, len(SYMBOLS)), "file": (0, len(FILES)), "directory": (0, 9)}


def test_many_on_one_line():
    text = "".join(f"function f{k}(){{g{k}()}}" for k in range(500)) + "class A extends B{}class C extends D{}import a from './a';import b from './b';export{A,C}"
    symbols, facts = scan(text, "javascript")
    assert len(symbols) == 502 and sum(f[0] == "CALLS" for f in facts) == 500
    assert [f[1] for f in facts if f[0] != "CALLS"] == ["B", "D", "./a", "./b"]


#: for each rule the edge columns that break it, or the tables that do
BROKEN = {
    "dangling source symbol": ("type = 'CALLS' and source_kind = 'symbol'", {"source": "'gone'"}), "dangling source file": ("type = 'IMPORTS'", {"source": "'gone'"}), "dangling source directory": ("source_kind = 'directory'", {"source": "'gone'"}),
    "dangling target symbol": ("type = 'CALLS' and target_kind = 'symbol'", {"target": "'gone'"}), "dangling target file": ("target_kind = 'file'", {"target": "'gone'"}), "dangling target directory": ("target_kind = 'directory'", {"target": "'gone'"}),
    "open state with target": ("state = 'RESOLVED'", {"state": "'UNKNOWN'"}), "settled state without target": ("state = 'RESOLVED'", {"target": "null", "target_kind": "null"}), "candidates on a settled edge": ("state = 'RESOLVED'", {"candidates": "array('a', 'b')"}),
    "ambiguous without candidates": ("state = 'AMBIGUOUS'", {"candidates": "array()"}), "ambiguous with fewer than two": ("state = 'AMBIGUOUS'", {"candidates": "slice(candidates, 1, 1)"}), "too many candidates": ("state = 'AMBIGUOUS'", {"candidates": "array_repeat(candidates[0], 21)"}),
    "dangling candidate": ("state = 'AMBIGUOUS'", {"candidates": "array('a', 'b')"}), "target of a wrong kind": ("type = 'EXPORTS'", {"type": "'IMPORTS'"}), "containment not extracted": ("type = 'CONTAINS'", {"state": "'RESOLVED'"}),
}


@pytest.mark.parametrize("rule", g.RULES)
def test_every_rule_sees_its_damage(files, built, rule):
    symbols, edges = built
    directories = directory_chain(files)
    if rule in BROKEN:
        where, changes = BROKEN[rule]
        n = edges.where(where).count()
        edges = edges.withColumns({c: F.when(F.expr(where), F.expr(v).cast(edges.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()})
    elif rule == "repeated symbol key":
        symbols, n = symbols.unionByName(symbols.where("name = 'helper'")), 1
    elif rule == "target of another family":
        symbols = symbols.withColumn("family", F.when(F.col("path") == "src/util.ts", "java").otherwise(F.col("family")))
        n = 2  # two sources call helper
    elif rule == "orphan directory":
        directories, n = directories.where("path <> 'a/com'"), 1
    else:
        files, n = files.where("path <> 'src/min.js'"), 1
    found = {r.rule: r.violations for r in g.invariants(edges, symbols, files, directories).collect()}
    assert found[rule] == n if rule != "dangling candidate" else found[rule] == 2 * n
