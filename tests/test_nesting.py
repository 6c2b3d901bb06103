"""Nesting inside a file as the scanner finds it, against the operators on tables of spans."""

import random

from pyspark.sql import functions as F

from lithic.operators import code, graph
from lithic.operators.symbols import nest


def test_same_as_on_tables(spark):
    rnd, symbols, facts = random.Random(5), [], []
    for file in range(40):
        starts = rnd.sample(range(60), 12)
        symbols += [(file, rnd.choice(["class", "function", "method"]), f"n{s}", s, min(59, s + rnd.choice([0, 2, 5, 30, 59]))) for s in starts]
        facts += [(file, at) for at in rnd.sample(range(60), 20)]
    table = spark.createDataFrame(symbols, "file_id long, kind string, name string, start_at long, end_at long").withColumn("symbol", F.col("start_at"))
    points = spark.createDataFrame(facts, "file_id long, at long").withColumn("fact", F.col("at"))
    nested = {(r.file_id, r.symbol): (r.parent, r.qualified_name) for r in nest(table.select("file_id", "symbol", "name", "start_at", "end_at")).collect()}
    around = {(r.file_id, r.fact): r.symbol for r in graph.enclosing(points, table.where("kind <> 'class'")).collect()}
    for file in range(40):
        own, ats = [s[1:] for s in symbols if s[0] == file], [at for f, at in facts if f == file]
        parents, bodies = code.nesting(own, ats)
        assert parents == [nested[file, s[2]] for s in own]
        assert bodies == [around[file, at] for at in ats]


def test_text_graph_moves_no_spans(spark):
    """Parents and callers come from the scan: no join lays out the stretches of spans."""
    text = "class A {\n  m() { f(1); }\n}\ng(2);\n"
    files = spark.createDataFrame([(1, 5, "x/a.ts", "typescript", text)], "snapshot_id long, id long, path string, language string, text string")
    found = graph.build_from_text(files)
    assert "_level" not in found._jdf.queryExecution().toString()
    rows = {(r.type, r.source, r.name, r.target) for r in found.collect()}
    assert {("CALLS", "x/a.ts#1:2", "f", None), ("CALLS", "x/a.ts", "g", None), ("CONTAINS", "x/a.ts#0:6", None, "x/a.ts#1:2"), ("CONTAINS", "x/a.ts", None, "x/a.ts#0:6")} <= rows


def test_counts_need_no_candidates(spark, small):
    """Who asks for no candidates is spared the windows that choose them; the last word of a line is found from its end."""
    from lithic.views import Tables

    t = Tables(spark, small)
    counts = graph.degrees(graph.build(t))
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "collect_list" not in plan
    lines = spark.createDataFrame([("Ab cd1e.\r\n",), ("12",), ("",), (None,), ("né X日本",)], "x string")
    assert [r[0] for r in lines.selectExpr(t._dialect.word("x", True)).collect()] == ["e", "", "", None, "X"]
    assert "$" not in t._dialect.word("x", True)
