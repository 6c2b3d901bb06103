"""A relationship graph that is kept up to date: what has not changed is neither scanned nor resolved again.

A versioned store holds one unit a file: its content hash and the version of the
scanner (the checkpoint), its symbols, its facts, and the edges that come from
it. An update scans the files whose checkpoint does not fit. The names whose
symbols differ, and the paths that came or went, lead through the stored facts to
the files that depend on them; those are resolved again, from stored facts, with
the changed ones. All of it is one commit, so a killed update changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.operators.graph import EDGE, TEXT_GRAPH, contains_edges, import_candidates, resolve_text, source_files, symbols_and_facts
from lithic.operators.symbols import VERSION, directory_chain
from lithic.registry import query
from lithic.saved import new_path, save
from lithic.sources.store import Store

UNION = DataFrame.unionByName
_SYMBOL = ["family", "fact", "kind", "name", "start_line", "start_column", "start_at", "end_at", "parent", "qualified_name"]
_FACT = ["family", "type", "name", "at", "owner_at", "around"]
_OWN = ["snapshot_id", "file_id", "path"]
_EDGE = [c for c in EDGE if c not in _OWN]


class KeptGraph:
    """The graph of files(snapshot_id, id, path, language, text[, content_hash]) under ``path``."""

    def __init__(self, spark: SparkSession, path: str, version: str = VERSION) -> None:
        self._store, self._version = Store(spark, path, "file_id"), version

    def units(self) -> DataFrame:
        return self._store.read()

    def edges(self) -> DataFrame:
        """All edges: those of the files, and those between folders, which depend on the paths alone."""
        units = self.units()
        files = units.select("snapshot_id", F.col("file_id").alias("id"), "path")
        folders = directory_chain(files)
        none = files.where("false")
        empty = _exploded(units.where("false"), "symbols", _SYMBOL)
        return UNION(_exploded(units, "edges", _EDGE).select(EDGE), contains_edges(none, empty, folders))

    def update(self, files: DataFrame) -> dict[str, int]:
        """Bring the graph to ``files``: how many were scanned, resolved and removed."""
        if "content_hash" not in files.columns:
            files = files.withColumn("content_hash", F.sha2("text", 256))
        meta = files.select("snapshot_id", F.col("id").alias("file_id"), "path", "language", "content_hash")
        first = not self._store.latest()
        units = None if first else self.units()
        same = ["snapshot_id", "file_id", "path", "language", "content_hash"]
        if first:
            changed, removed = meta, meta.where("false").select("file_id")
        else:
            current = units.where(F.col("version") == self._version).select(*(F.col(c).alias(f"_{c}") for c in same))
            fits = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same))
            changed = meta.join(current, fits, "left_anti")
            removed = units.select("file_id").join(meta.select("file_id"), "file_id", "left_anti")
        changed, removed = save(changed, "changed"), save(removed, "removed")
        scanned, gone = changed.count(), removed.count()
        if not scanned and not gone:
            return {"scanned": 0, "resolved": 0, "removed": 0}
        symbols, facts = symbols_and_facts(files.join(changed.select(F.col("file_id").alias("id")), "id", "left_semi"))
        work = changed.select("file_id")
        if not first:
            touched = UNION(work, removed)
            old = units.join(touched, "file_id", "left_semi")
            rest = units.join(touched, "file_id", "left_anti")
            names = _difference(_exploded(old, "symbols", _SYMBOL), symbols, ["snapshot_id", "family", "kind", "name", "fact"]).select("snapshot_id", "family", "name").distinct()
            paths = _difference(old, changed, ["snapshot_id", "path"]).distinct()
            kept_facts = _exploded(rest, "facts", _FACT)
            depends = save(_dependants(kept_facts, names, paths), "dependants")
            work = save(UNION(work, depends), "work")
            facts = UNION(facts.select(*_OWN, *_FACT), kept_facts.join(depends, "file_id", "left_semi").select(*_OWN, *_FACT))
            symbols = save(UNION(symbols.select(*_OWN, *_SYMBOL), _exploded(rest, "symbols", _SYMBOL).select(*_OWN, *_SYMBOL)), "all-symbols")
        facts = save(facts.select(*_OWN, *_FACT), "facts")
        mine = meta.join(work, "file_id", "left_semi")
        own = symbols.join(work, "file_id", "left_semi")
        placed = mine.select("snapshot_id", F.col("file_id").alias("id"), "path")
        folders = directory_chain(placed).where("false")
        edges = UNION(contains_edges(placed, own, folders), resolve_text(meta.withColumnRenamed("file_id", "id"), symbols, facts))
        rows = mine.withColumn("version", F.lit(self._version))
        for name, part, columns in (("symbols", own, _SYMBOL), ("facts", facts, _FACT), ("edges", edges, _EDGE)):
            lists = part.groupBy("file_id").agg(F.collect_list(F.struct(*columns)).alias(name))  # one file's
            rows = rows.join(lists, "file_id", "left")
        self._store.replace(rows, UNION(rows.select("file_id"), removed))
        return {"scanned": scanned, "resolved": work.count(), "removed": gone}


def _exploded(units: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return units.select(*_OWN, F.explode(name).alias("_x")).select(*_OWN, *(F.col(f"_x.{c}").alias(c) for c in columns))


def _difference(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one of two tables and not of the other."""
    tagged = UNION(old.select(*columns, F.lit(1).alias("_o"), F.lit(0).alias("_n")), new.select(*columns, F.lit(0).alias("_o"), F.lit(1).alias("_n")))
    return tagged.groupBy(*columns).agg(F.max("_o").alias("_o"), F.max("_n").alias("_n")).where("_o <> _n").select(*columns)


def _dependants(facts: DataFrame, names: DataFrame, paths: DataFrame) -> DataFrame:
    """Files with a fact that one of the names may resolve, or an import that one of the paths may."""
    called = facts.withColumn("name", F.element_at(F.split("name", "\\."), -1)).join(names, ["snapshot_id", "family", "name"], "left_semi").select("file_id")
    imports = facts.where("type = 'IMPORTS' and family = 'script'").select("snapshot_id", "file_id", "path", F.col("name").alias("spec"))
    led = import_candidates(imports).join(paths.withColumnRenamed("path", "candidate"), ["snapshot_id", "candidate"], "left_semi").select("file_id")
    return UNION(called, led).distinct()


@query("rel11_update", TEXT_GRAPH)
def rel11_update(t):
    """The graph of all source files, brought up to date from one in which a tenth of them had other texts and another tenth was missing."""
    files = source_files(t)
    kept = KeptGraph(t.spark, new_path(t.spark, "graph"))
    kept.update(files.where("id % 10 <> 7").withColumn("text", F.when(F.col("id") % 10 == 3, F.lit("class Before {}")).otherwise(F.col("text"))))
    kept.update(files)
    return kept.edges().select("snapshot_id", "type", "source", "target", "state", F.array_join("candidates", ",").alias("candidates"), "key")
