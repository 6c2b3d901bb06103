"""Audit of all tables against the rules that their schema states, as numbers of violations.

A rule says what no row may be (``check``), which columns are unique, or which
rows must exist elsewhere (``refers``). The conditions are SQL that Spark and the
twin share; each table is read once for all its conditions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.operators.graph import CALLS, SYMBOLS, _calls, _edges_of, _symbols
from lithic.operators.snapshots import JOBS, job_states
from lithic.registry import query

_one_of = lambda column, *values: f"{column} IS NULL OR {column} NOT IN ({', '.join(repr(v) for v in values)})"

# ---- fixed values: the states, kinds and types that columns may hold
CHECKS = {
    "snapshots": {
        "snapshot status": _one_of("status", "pending", "in_progress", "completed", "failed"),
        "acquisition mode": _one_of("acquisition_mode", "bulk_archive", "incremental_api"),
        "completed without time": "status = 'completed' AND completed_at IS NULL",
    },
    "jobs": {"job status": _one_of("status", "pending", "retrying", "failed", "completed")},
    "extractions": {"extraction status": _one_of("status", "extracted", "skipped_unsupported", "failed")},
    "symbols": {"symbol kind": _one_of("kind", "module", "class", "interface", "function", "method")},
    "edges": {
        "edge type": _one_of("type", "CONTAINS", "IMPORTS", "EXPORTS", "CALLS", "EXTENDS", "IMPLEMENTS", "USES", "REFERENCES"),
        "source kind": _one_of("source_kind", "directory", "file", "symbol"),
        "target kind": "target_kind IS NOT NULL AND target_kind NOT IN ('directory', 'file', 'symbol')",
        "edge state": _one_of("state", "EXTRACTED", "RESOLVED", "INFERRED", "AMBIGUOUS", "UNKNOWN"),
        "confidence of inferred edges only": "(state = 'INFERRED') <> (confidence IS NOT NULL) OR confidence < 0 OR confidence > 1",
    },
}
UNIQUE = {
    "attempt of a commit": ("snapshots", ["repository_id", "commit_sha", "attempt_number"]),
    "path of a file": ("files", ["snapshot_id", "path"]),
    "unit of a job": ("jobs", ["snapshot_id", "unit_index"]),
    "path of a directory": ("directories", ["snapshot_id", "path"]),
    "extraction of a file": ("extractions", ["snapshot_id", "file_id"]),
    "key of a symbol": ("symbols", ["file_id", "fact"]),
    "key of an edge": ("edges", ["snapshot_id", "key"]),
}
REFERS = {
    "file without snapshot": ("files", ["snapshot_id"], "snapshots", ["id"]),
    "job without snapshot": ("jobs", ["snapshot_id"], "snapshots", ["id"]),
    "directory without snapshot": ("directories", ["snapshot_id"], "snapshots", ["id"]),
    "directory without parent": ("directories", ["snapshot_id", "parent_path"], "directories", ["snapshot_id", "path"]),
    "extraction without its file": ("extractions", ["file_id"], "files", ["id"]),
    "symbol without extraction": ("symbols", ["file_id"], "extractions", ["file_id"]),
    "edge without evidence": ("edges", ["file_id"], "extractions", ["file_id"]),
}


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """rule and violations for every rule of the tables given."""
    parts = []
    for name, rules in CHECKS.items():
        if name in tables:
            counted = tables[name].agg(*(F.count_if(F.coalesce(F.expr(broken), F.lit(False))).alias(f"r{k}") for k, broken in enumerate(rules.values())))
            parts.append(counted.select(F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(f"r{k}").alias("violations")) for k, rule in enumerate(rules)))).alias("r")).select("r.*"))
    named = lambda rule, rows: rows.select(F.lit(rule).alias("rule"), "violations")
    n = F.count(F.lit(1))
    for rule, (name, keys) in UNIQUE.items():
        if name in tables:
            parts.append(named(rule, tables[name].groupBy(*keys).agg(n.alias("n")).where("n > 1").agg(n.alias("violations"))))
    for rule, (name, keys, other, ends) in REFERS.items():
        if name in tables and other in tables:
            known = tables[other].select(*(F.col(e).alias(k) for k, e in zip(keys, ends, strict=True))).distinct()
            used = tables[name].where(reduce(Column.__and__, (F.col(k).isNotNull() for k in keys)))
            parts.append(named(rule, used.join(known, keys, "left_anti").agg(n.alias("violations"))))
    return reduce(DataFrame.unionByName, parts)


#: damage done to the tables so that rules have something to count: table -> (columns in SQL, rows left)
_DAMAGE = {
    "snapshots": ("id, repository_id, commit_sha, CASE WHEN id % 90 = 1 THEN 1 ELSE attempt_number END AS attempt_number, CASE WHEN id % 70 = 3 THEN 'gone' ELSE status END AS status, CASE WHEN id % 80 <> 5 THEN acquisition_mode END AS acquisition_mode, CASE WHEN id % 6 <> 1 THEN completed_at END AS completed_at", "id <> 3"),
    "jobs": ("snapshot_id, CASE WHEN unit_index = 4 AND snapshot_id % 3 = 0 THEN 0 ELSE unit_index END AS unit_index, CASE WHEN unit_index = 3 AND snapshot_id % 4 = 0 THEN 'late' ELSE status END AS status", "snapshot_id > 0"),
    "extractions": ("CASE WHEN file_id % 33 IN (4, 5) THEN 1 ELSE snapshot_id END AS snapshot_id, CASE WHEN file_id % 33 = 4 THEN file_id + 1 ELSE file_id END AS file_id, CASE WHEN file_id % 50 = 7 THEN 'odd' ELSE status END AS status", "file_id % 45 <> 2"),
    "symbols": ("file_id, CASE WHEN start_line % 40 = 8 THEN 'path' ELSE fact END AS fact, CASE WHEN start_line % 30 = 4 THEN 'field' ELSE kind END AS kind", "file_id > 0"),
    "edges": ("snapshot_id, file_id, CASE WHEN length(source) % 9 = 0 THEN 'LIKES' ELSE 'CALLS' END AS type, CASE WHEN length(source) % 6 = 0 THEN 'row' ELSE 'symbol' END AS source_kind, CASE WHEN state = 'RESOLVED' THEN CASE WHEN length(source) % 7 = 0 THEN 'thing' ELSE 'symbol' END END AS target_kind, CASE WHEN length(source) % 11 = 0 THEN 'INFERRED' WHEN length(source) % 7 = 1 THEN 'GUESSED' ELSE state END AS state, CASE WHEN length(source) % 5 = 0 THEN 0.5 WHEN length(source) % 13 = 0 THEN 1.5 END AS confidence, CASE WHEN length(source) % 8 = 0 THEN 'same' ELSE key END AS key", "file_id > 0"),
    "files": ("id, snapshot_id, CASE WHEN id % 60 = 9 THEN 'same' ELSE path END AS path", "id % 48 <> 6"),
    "directories": ("snapshot_id, CASE WHEN path LIKE '%/m1' OR path LIKE '%/m2' THEN 'x' WHEN path = 'en' THEN 'y' ELSE path END AS path, parent_path", "snapshot_id > 0"),
}
_SOURCES = {
    "jobs": JOBS,
    "symbols": f"{SYMBOLS} s",
    "edges": f"(SELECT snapshot_id, file_id, fact AS source, state, sha256(concat_ws(' ', snapshot_id, 'CALLS', fact, coalesce(target, '∅'), callee)) AS key FROM {CALLS} c) e",
}


def _damaged_sql(name: str) -> str:
    columns, left = _DAMAGE[name]
    return f"(SELECT {columns} FROM {_SOURCES.get(name, name + ' t')} WHERE {left})"


def _audit_sql() -> str:
    """The same rules for DuckDB, over the damaged tables."""
    parts = [f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE {broken}) AS violations FROM d_{name}" for name, rules in CHECKS.items() for rule, broken in rules.items()]
    parts += [f"SELECT '{rule}', count(*) FROM (SELECT 1 FROM d_{name} GROUP BY {', '.join(keys)} HAVING count(*) > 1) q" for rule, (name, keys) in UNIQUE.items()]
    for rule, (name, keys, other, ends) in REFERS.items():
        same = " AND ".join(f"o.{e} = u.{k}" for k, e in zip(keys, ends, strict=True))
        parts.append(f"SELECT '{rule}', count(*) FROM d_{name} u WHERE {' AND '.join(f'u.{k} IS NOT NULL' for k in keys)} AND NOT EXISTS (SELECT 1 FROM d_{other} o WHERE {same})")
    return "WITH " + ", ".join(f"d_{name} AS MATERIALIZED {_damaged_sql(name)}" for name in _DAMAGE) + " " + " UNION ALL ".join(parts)


@query("sch1_all", _audit_sql())
def sch1_all(t):
    """Every rule over tables with rows damaged on purpose."""
    sources = {"jobs": job_states(t("job_events")), "symbols": _symbols(t), "edges": _edges_of(_calls(t), "CALLS")}
    damaged = {name: (sources[name] if name in sources else t(name)).where(left).selectExpr(*_split(columns)) for name, (columns, left) in _DAMAGE.items()}
    return audit(damaged)


def _split(columns: str) -> list[str]:
    """A select list at its outer commas."""
    parts, depth, last = [], 0, 0
    for k, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(columns[last:k])
            last = k + 1
    return [*parts, columns[last:]]
