"""Typed relationship graph: resolution of facts to edges, invariants, fingerprints, queries.

Edges are rows (snapshot_id, type, source, target, target_kind, state, method,
key, candidates). A reference is a path for files and directories and path#line
for symbols (path#line:column where they come from text), so that nothing
depends on row ids. ``build_from_text`` makes a graph of source files alone:
declarations, nesting, facts, the symbols around them, resolution. ``build``
does the second half of it from symbols and facts that are given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic.operators.code import NO_CALL, scan_files
from lithic.operators.edge_store import pages, read_edges, write_edges
from lithic.operators.quantiles import middle_and_p95
from lithic.operators.symbols import around_points, directory_chain
from lithic.registry import query
from lithic.saved import new_path, save

# ---- fixed values
CANDIDATES = 20
SCRIPT_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts"]
SCRIPT_SWAPS = [".ts", ".tsx", ".mts", ".cts"]
TYPES = ["CONTAINS", "IMPORTS", "CALLS", "EXTENDS", "IMPLEMENTS", "EXPORTS"]
NONE = "∅"
UNION = DataFrame.unionByName


def enclosing(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Innermost symbol(file_id, symbol, start_at, end_at) around each fact(file_id, fact, at), null outside."""
    spans = symbols.where("start_at <= end_at").select("file_id", "symbol", "start_at", "end_at", F.col("start_at").alias("s"), F.col("end_at").alias("e"))
    inner = around_points(facts.select("file_id", "fact", "at"), "at", spans)
    found = inner.groupBy("file_id", "fact").agg(F.max_by("symbol", F.struct("s", -F.col("e"), "symbol")).alias("symbol"))
    return facts.join(found, ["file_id", "fact"], "left").select("file_id", "fact", "symbol")


@query("rel2", "SELECT f.event_id AS fact, arg_max(s.event_id, (s.start_at, -s.end_at, s.event_id)) AS symbol FROM events f LEFT JOIN spans s ON s.user_id = f.user_id AND s.start_at <= f.event_id % 997 AND f.event_id % 997 <= s.end_at GROUP BY 1")
def rel2_enclosing(t):
    facts = t("events").select(F.col("event_id").alias("fact"), F.col("user_id").alias("file_id"), (F.col("event_id") % 997).alias("at"))
    symbols = t("spans").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("symbol"), "start_at", "end_at")
    return enclosing(facts, symbols).select("fact", "symbol")


def extract_facts(files: DataFrame) -> DataFrame:
    """Import, call, heritage and export facts of files(file_id, text[, language]) with their line, in order."""
    found = scan_files(files, ["file_id"]).where("what = 'fact'")
    return found.select("file_id", "line", F.col("column").alias("place"), "type", "name")


@query("rel1", f"SELECT file_id, start_line AS line, 'CALLS' AS type, callee AS name FROM text_lines WHERE callee <> '' AND callee NOT IN {tuple(sorted(NO_CALL))} UNION ALL SELECT file_id, start_line, 'IMPORTS', concat('./', name) FROM text_lines WHERE kind = 'class' AND name <> ''")
def rel1_facts(t):
    """Facts in code made of the documents' lines: a call a line, an import for each first line."""
    code = F.concat(F.when(F.col("kind") == "class", F.concat(F.lit("import x from './"), "name", F.lit("'; "))).otherwise(""), F.when(F.col("callee") != "", F.concat("callee", F.lit("(1);"))).otherwise(""))
    found = extract_facts(t("text_lines").select(F.struct("file_id", "start_line").alias("file_id"), code.alias("text")))
    return found.select("file_id.file_id", F.col("file_id.start_line").alias("line"), "type", "name").where("type in ('CALLS', 'IMPORTS') and name <> './'")


def import_base(path: Column, spec: Column) -> Column:
    """The path that a relative import means, before extensions; null for other imports."""
    folder = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    step = lambda at, part: F.when(part.isin(".", ""), at).when(part == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(part)))
    relative = F.rlike(spec, F.lit(r"^\.\.?(/|$)"))
    return F.when(relative, F.array_join(F.aggregate(F.split(spec, "/"), folder, step), "/"))


def import_candidates(imports: DataFrame) -> DataFrame:
    """imports(path, spec, ...) with the paths to try, in order: (precedence, candidate)."""
    base = imports.withColumn("_base", import_base(F.col("path"), F.col("spec"))).where("_base is not null")
    bare = F.regexp_replace("_base", r"\.(m|c)?jsx?$", "")
    exact = [F.col("_base"), *(F.concat("_base", F.lit(e)) for e in SCRIPT_EXTENSIONS)]
    swapped = F.when(bare != F.col("_base"), F.array(*(F.concat(bare, F.lit(e)) for e in SCRIPT_SWAPS))).otherwise(F.array().cast("array<string>"))
    index = [F.concat("_base", F.lit(f"/index{e}")) for e in SCRIPT_EXTENSIONS]
    return base.select(*imports.columns, F.posexplode(F.concat(F.array(*exact), swapped, F.array(*index))).alias("precedence", "candidate"))


def _imports(t) -> DataFrame:
    """One relative import a file, to a neighbour in the same or in the next folder, some with .js."""
    k = F.col("doc_id")
    there = F.concat(F.lit("f"), k + F.when(k % 3 == 1, 6).otherwise(1), F.when(k % 4 == 0, ".js").otherwise(""))
    spec = F.when(k % 3 == 1, F.concat(F.lit("./"), there)).when(k % 3 == 2, F.concat(F.lit("../m"), (k + 1) % 6, F.lit("/./"), there)).otherwise("package")
    return t("files").select("snapshot_id", F.col("id").alias("file_id"), "path", spec.alias("spec"))


_BASE = "(SELECT snapshot_id, id AS file_id, doc_id, concat(split_part(path, '/', 1), '/m', CASE WHEN doc_id % 3 = 1 THEN doc_id % 6 ELSE (doc_id + 1) % 6 END, '/f', doc_id + CASE WHEN doc_id % 3 = 1 THEN 6 ELSE 1 END, CASE WHEN doc_id % 4 = 0 THEN '.js' ELSE '' END) AS base FROM files WHERE doc_id % 3 <> 0)"
_TRY = f"(SELECT snapshot_id, file_id, k - 1 AS precedence, tries[k] AS candidate FROM (SELECT *, unnest(range(1, len(tries) + 1)) AS k FROM (SELECT *, list_concat([base], [base || e for e in {SCRIPT_EXTENSIONS}], CASE WHEN doc_id % 4 = 0 THEN [replace(base, '.js', '') || e for e in {SCRIPT_SWAPS}] ELSE [] END, [base || '/index' || e for e in {SCRIPT_EXTENSIONS}]) AS tries FROM {_BASE} b) c) d)"


@query("rel3", f"SELECT file_id, precedence, candidate FROM {_TRY} x")
def rel3_candidates(t):
    return import_candidates(_imports(t)).select("file_id", "precedence", "candidate")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The first candidate path that the snapshot has, for each import(snapshot_id, file_id, path, spec): target, state."""
    known = files.select("snapshot_id", F.col("path").alias("candidate"))
    tries = import_candidates(imports.select("snapshot_id", "file_id", "path", "spec").distinct())
    found = tries.join(known, ["snapshot_id", "candidate"]).groupBy("file_id", "spec").agg(F.min_by("candidate", "precedence").alias("target"))
    return imports.join(found, ["file_id", "spec"], "left").select("snapshot_id", "file_id", "path", "spec", "target", F.when(F.col("target").isNull(), "UNKNOWN").otherwise("RESOLVED").alias("state"))


@query("rel4", f"SELECT f.id AS file_id, arg_min(g.path, precedence) AS target, CASE WHEN arg_min(g.path, precedence) IS NULL THEN 'UNKNOWN' ELSE 'RESOLVED' END AS state FROM files f LEFT JOIN (SELECT x.file_id, g.path, precedence FROM {_TRY} x JOIN files g ON g.snapshot_id = x.snapshot_id AND g.path = candidate) g ON g.file_id = f.id GROUP BY 1")
def rel4_imports(t):
    return resolve_imports(_imports(t), t("files")).select("file_id", "target", "state")


def resolve_dotted(imports: DataFrame, types: DataFrame) -> DataFrame:
    """Dotted names of imports(snapshot_id, file_id, spec) to the file that declares them.

    types(snapshot_id, name, path) are named by the last part of a dotted name
    and found by all its parts. One row stands for all files with the same name
    and path ending, so an ending that many files share costs one row an import.
    """
    parts = F.split("path", "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    keys = ["snapshot_id", "name", "_tail"]
    asked = imports.select("snapshot_id", F.substring_index("spec", ".", -1).alias("name"), F.concat(F.replace("spec", F.lit("."), F.lit("/")), F.lit(".java")).alias("_tail")).distinct()
    # only endings that some import asks for are kept; of their paths the first ones leave a task
    ends = types.select("snapshot_id", "name", "path").distinct().withColumn("_tail", F.explode(endings)).join(asked, keys, "left_semi")
    counts = ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("found"))
    first = ends.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy("path"))).where(F.col("_k") <= CANDIDATES)
    table = counts.join(first.groupBy(*keys).agg(F.array_sort(F.collect_list("path")).alias("several")), keys)
    wanted = imports.withColumns({"name": F.substring_index("spec", ".", -1), "_tail": F.concat(F.replace("spec", F.lit("."), F.lit("/")), F.lit(".java"))})
    joined = wanted.join(table, ["snapshot_id", "name", "_tail"], "left")
    n = F.coalesce("n", F.lit(0))
    state = F.when(n == 1, "RESOLVED").when(n > 1, "AMBIGUOUS").otherwise("UNKNOWN")
    return joined.select(*imports.columns, F.when(n == 1, F.col("found")).alias("target"), state.alias("state"), F.when(n > 1, F.col("several")).alias("candidates"))


@query("rel5", "WITH i AS (SELECT id AS file_id, snapshot_id, doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('m', (doc_id - doc_id % 10 + 2) % 6, '.f', doc_id - doc_id % 10 + 2) ELSE concat('x.f', doc_id - doc_id % 10 + 2) END AS spec FROM files), h AS (SELECT i.file_id, count(DISTINCT f.path) AS n, min(f.path) AS path FROM i JOIN files f ON f.snapshot_id = i.snapshot_id AND ends_with(f.path, '.java') AND ends_with(f.path, concat('/', replace(spec, '.', '/'), '.java')) GROUP BY 1) SELECT i.file_id, CASE WHEN n = 1 THEN path END AS target, CASE WHEN n = 1 THEN 'RESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'UNKNOWN' END AS state FROM i LEFT JOIN h USING (file_id)")
def rel5_dotted(t):
    k = F.col("doc_id") - F.col("doc_id") % 10 + 2
    spec = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("m"), k % 6, F.lit(".f"), k)).otherwise(F.concat(F.lit("x.f"), k))
    types = t("files").where(F.endswith("path", F.lit(".java"))).select("snapshot_id", F.regexp_extract("path", r"([^/]*)\.java$", 1).alias("name"), "path")
    return resolve_dotted(t("files").select(F.col("id").alias("file_id"), "snapshot_id", spec.alias("spec")), types).select("file_id", "target", "state")


def _table(symbols: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Number of symbols under each key, the one that is alone, and of several the first ones in order: one row a key, however common the name.

    Numbers are counted before the shuffle; of the symbols only the first ones of
    each key leave a task.
    """
    ref = F.col("fact") if "fact" in symbols.columns else F.concat("path", F.lit("#"), "start_line")
    order = [c for c in ("path", "start_line", "start_column") if c in symbols.columns]
    counts = symbols.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(ref).alias("only"))
    first = symbols.select(*keys, ref.alias("ref"), F.row_number().over(W.partitionBy(*keys).orderBy(*order)).alias("k")).where(F.col("k") <= most)
    refs = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "ref"))), lambda x: x["ref"]).alias("refs")).where(F.size("refs") > 1)
    # a left join: who asks for no candidates is spared them
    return counts.join(refs, keys, "left")


#: what symbols a fact may mean, by the fact's type
MEANS = {"CALLS": ("callable", ["function", "method"]), "EXTENDS": ("type", ["class", "interface"]), "IMPLEMENTS": ("type", ["class", "interface"])}


def _resolved(facts: DataFrame, symbols: DataFrame, also: list[str], most: int) -> DataFrame:
    """Facts with state, target and candidates; symbols and facts agree in name and in the columns ``also``."""
    by_file, by_name = ["file_id", *also, "callee"], ["snapshot_id", "family", *also, "callee"]
    near, far = (_table(symbols, keys, most).select(*keys, *(F.col(c).alias(f"{c}{k}") for c in ("n", "only", "refs"))) for k, keys in ((1, by_file), (2, by_name)))
    joined = facts.join(near, by_file, "left").join(far, by_name, "left")
    n = F.coalesce("n1", "n2", F.lit(0))
    state = F.when(n == 1, "RESOLVED").when(n > 1, "AMBIGUOUS").otherwise("UNKNOWN")
    of_near = F.col("n1").isNotNull()
    target, refs = (F.when(of_near, F.col(f"{c}1")).otherwise(F.col(f"{c}2")) for c in ("only", "refs"))
    return joined.select(*facts.columns, state.alias("state"), F.when(n == 1, target).alias("target"), F.when(n > 1, refs).alias("candidates"))


def _named(symbols: DataFrame) -> DataFrame:
    return symbols.select("snapshot_id", "file_id", "family", "path", "start_line", "kind", F.col("name").alias("callee"), *(c for c in ("start_column", "fact") if c in symbols.columns))


def resolve_names(facts: DataFrame, symbols: DataFrame, kinds: list[str], most: int = CANDIDATES) -> DataFrame:
    """Target of each fact(fact, file_id, snapshot_id, family, callee): its own file first, else its snapshot and family.

    One hit resolves, several leave it ambiguous with the first candidates, none unknown.
    """
    return _resolved(facts, _named(symbols).where(F.col("kind").isin(*kinds)), [], most)


def resolve_facts(facts: DataFrame, symbols: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """``resolve_names`` for facts(type, ...) of all types in MEANS at once: names are gathered and joined once."""
    role = F.coalesce(*(F.when(F.col("type") == kind, F.lit(r)) for kind, (r, _) in MEANS.items()))
    meant = dict(MEANS.values())
    of = F.coalesce(*(F.when(F.col("kind").isin(*kinds), F.lit(r)) for r, kinds in meant.items()))
    fit = _named(symbols).withColumn("role", of).where("role is not null")
    return _resolved(facts.withColumn("role", role), fit, ["role"], most).drop("role")


def _symbols(t) -> DataFrame:
    """Lines of source files as symbols with their language family; the texts are taken apart once."""
    family = F.when(F.col("language") == "java", "java").otherwise("script")
    languages = t("extractions").where("language is not null").select("file_id", family.alias("family"))
    named = t("text_lines").where("name <> ''").join(languages, "file_id").withColumn("fact", F.concat("path", F.lit("#"), "start_line"))
    return t.saved("symbols", lambda: named)


SYMBOLS = "(SELECT l.*, CASE WHEN e.language = 'java' THEN 'java' ELSE 'script' END AS family, concat(l.path, '#', l.start_line) AS fact FROM text_lines l JOIN extractions e USING (file_id) WHERE e.language IS NOT NULL AND l.name <> '')"


def _resolved_sql(kinds: str, facts: str) -> str:
    return f"""(WITH s AS MATERIALIZED (SELECT * FROM {SYMBOLS} y), c AS (SELECT *, row_number() OVER (PARTITION BY file_id, name ORDER BY path, start_line) AS k1, row_number() OVER (PARTITION BY snapshot_id, family, name ORDER BY path, start_line) AS k2 FROM s WHERE kind IN ({kinds})),
      a AS (SELECT file_id, name, count(*) AS n, list(fact ORDER BY path, start_line) FILTER (WHERE k1 <= 20) AS refs FROM c GROUP BY 1, 2), b AS (SELECT snapshot_id, family, name, count(*) AS n, list(fact ORDER BY path, start_line) FILTER (WHERE k2 <= 20) AS refs FROM c GROUP BY 1, 2, 3)
      SELECT f.*, CASE coalesce(a.n, b.n, 0) WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS state, CASE WHEN coalesce(a.n, b.n) = 1 THEN coalesce(a.refs, b.refs)[1] END AS target, CASE WHEN coalesce(a.n, b.n) > 1 THEN coalesce(a.refs, b.refs) END AS candidates
      FROM (SELECT * FROM s WHERE {facts}) f LEFT JOIN a ON a.file_id = f.file_id AND a.name = f.callee LEFT JOIN b ON b.snapshot_id = f.snapshot_id AND b.family = f.family AND b.name = f.callee)"""


CALLS = _resolved_sql("'function', 'method'", "callee <> ''")
HERITAGE = _resolved_sql("'class', 'interface'", "kind = 'class' AND callee <> ''")


def _calls(t) -> DataFrame:
    symbols = _symbols(t)
    facts = symbols.where("callee <> ''").select("fact", "file_id", "snapshot_id", "path", "family", "callee")
    return resolve_names(facts, symbols, ["function", "method"])


@query("rel6", f"SELECT fact, file_id, state, target FROM {CALLS} x")
def rel6_calls(t):
    return _calls(t).select("fact", "file_id", "state", "target")


def _heritage(t) -> DataFrame:
    symbols = _symbols(t)
    facts = symbols.where("kind = 'class' and callee <> ''").select("fact", "file_id", "snapshot_id", "path", "family", "callee")
    return resolve_names(facts, symbols, ["class", "interface"])


@query("rel7", f"SELECT fact, state, target FROM {HERITAGE} x")
def rel7_heritage(t):
    return _heritage(t).select("fact", "state", "target")


def resolve_exports(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """The first class, function or interface of the file with the exported name(file_id, callee)."""
    fit = symbols.where(F.col("kind").isin("class", "function", "interface")).select("file_id", F.col("name").alias("callee"), F.struct(*(c for c in ("start_line", "start_column") if c in symbols.columns)).alias("o"), "fact").withColumnRenamed("fact", "ref")
    first = fit.groupBy("file_id", "callee").agg(F.min_by("ref", "o").alias("target"))
    return facts.join(first, ["file_id", "callee"], "left").withColumn("state", F.when(F.col("target").isNull(), "UNKNOWN").otherwise("RESOLVED"))


def _exports(t) -> DataFrame:
    symbols = _symbols(t)
    facts = symbols.where("start_line % 2 = 0 and callee <> ''").select("snapshot_id", "file_id", "path", "fact", "callee")
    return resolve_exports(facts, symbols)


EXPORTS = f"(WITH s AS MATERIALIZED (SELECT * FROM {SYMBOLS} y), c AS (SELECT file_id, name, arg_min(fact, start_line) AS target FROM s WHERE kind IN ('class', 'function') GROUP BY 1, 2) SELECT s.snapshot_id, s.file_id, s.path, fact, c.target, CASE WHEN c.target IS NULL THEN 'UNKNOWN' ELSE 'RESOLVED' END AS state FROM s LEFT JOIN c ON c.file_id = s.file_id AND c.name = s.callee WHERE start_line % 2 = 0 AND callee <> '')"


@query("rel8", f"SELECT fact, target, state FROM {EXPORTS} x")
def rel8_exports(t):
    return _exports(t).select("fact", "target", "state")


@query("rel9", f"SELECT fact, array_to_string(candidates, '|') AS candidates FROM {CALLS} x WHERE state = 'AMBIGUOUS'")
def rel9_candidates(t):
    return _calls(t).where("state = 'AMBIGUOUS'").select("fact", F.array_join("candidates", "|").alias("candidates"))


def edge_key(snapshot: Column, kind: Column, source: Column, target: Column, name: Column) -> Column:
    parts = [snapshot.cast("string"), kind, source, F.coalesce(target, F.lit(NONE)), F.coalesce(name, F.lit(NONE))]
    return F.sha2(F.concat_ws(" ", *parts), 256)


@query("rel10", f"SELECT fact, sha256(concat_ws(' ', snapshot_id, 'CALLS', fact, coalesce(target, '∅'), callee)) AS key FROM {CALLS} x")
def rel10_key(t):
    return _calls(t).select("fact", edge_key(F.col("snapshot_id"), F.lit("CALLS"), F.col("fact"), F.col("target"), F.col("callee")).alias("key"))


def persist(stored: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Stored edges with those of touched (snapshot_id, path, type) replaced, each key once."""
    keys = ["snapshot_id", "path", "type"]
    return UNION(stored.join(touched.select(keys).distinct(), keys, "left_anti"), fresh).dropDuplicates(["snapshot_id", "key"])


@query("rel11", f"SELECT fact, type, CASE WHEN file_id % 4 = 0 THEN 'new' ELSE 'old' END AS origin FROM (SELECT fact, file_id, 'CALLS' AS type FROM {CALLS} x) q")
def rel11_persist(t):
    edges = _edges_of(_calls(t), "CALLS")
    touched = edges.where(F.col("file_id") % 4 == 0)
    kept = persist(edges.withColumn("origin", F.lit("old")), UNION(touched, touched).withColumn("origin", F.lit("new")), touched)
    return kept.select(F.col("source").alias("fact"), "type", "origin")


EDGE = ["snapshot_id", "type", "source_kind", "source", "target_kind", "target", "state", "name", "key", "candidates", "path", "file_id"]


def _edges_of(resolved: DataFrame, kind: str | None, source_kind: str = "symbol", target_kind: str = "symbol") -> DataFrame:
    """Resolved facts as edges of one type, or of the types they name."""
    has = lambda c, default: F.col(c) if c in resolved.columns else F.lit(None).cast(default)
    rows = resolved.select(
        "snapshot_id", F.lit(kind).alias("type") if kind else "type", F.lit(source_kind).alias("source_kind"), (F.col("fact") if source_kind == "symbol" else F.col("path")).alias("source"), F.when(F.col("target").isNotNull(), target_kind).alias("target_kind"),
        "target", "state", has("callee", "string").alias("name"), has("candidates", "array<string>").alias("candidates"), "path", "file_id",
    )
    return rows.withColumn("key", edge_key(F.col("snapshot_id"), F.col("type"), F.col("source"), F.col("target"), F.col("name"))).select(EDGE)


def contains_edges(files: DataFrame, symbols: DataFrame, directories: DataFrame) -> DataFrame:
    """CONTAINS edges: folder to folder, folder to file, file to top-level symbol, symbol to child."""
    text = lambda c: F.col(c) if c else F.lit(None).cast("string")

    def edges(rows: DataFrame, source_kind: str, source: str, target_kind: str, target: str) -> DataFrame:
        made = rows.select(
            "snapshot_id", F.lit("CONTAINS").alias("type"), F.lit(source_kind).alias("source_kind"), F.col(source).alias("source"), F.lit(target_kind).alias("target_kind"), F.col(target).alias("target"),
            F.lit("EXTRACTED").alias("state"), text(None).alias("name"), F.lit(None).cast("array<string>").alias("candidates"), (F.col("path") if "path" in rows.columns else text(None)).alias("path"), (F.col("file_id") if "file_id" in rows.columns else F.lit(None).cast("long")).alias("file_id"),
        )
        return made.withColumn("key", edge_key(F.col("snapshot_id"), F.col("type"), F.col("source"), F.col("target"), F.col("name"))).select(EDGE)

    from lithic.sources.paths import directory_of

    folders = directories.where("parent_path is not null")
    placed = files.select("snapshot_id", "path", F.col("id").alias("file_id"), directory_of(F.col("path")).alias("folder"))
    return reduce(UNION, [
        edges(folders, "directory", "parent_path", "directory", "path"),
        edges(placed, "directory", "folder", "file", "path"),
        edges(symbols.where("parent is null"), "file", "path", "symbol", "fact"),
        edges(symbols.where("parent is not null"), "symbol", "parent", "symbol", "fact"),
    ])


def _nested(t) -> DataFrame:
    """Symbols whose parent is the class on their file's first line, where there is one."""
    symbols = _symbols(t)
    heads = symbols.where("kind = 'class'").select("file_id", F.col("fact").alias("head"))
    return symbols.join(heads, "file_id", "left").withColumn("parent", F.when(F.col("head") != F.col("fact"), F.col("head")))


CONTAINED = f"""(WITH y AS MATERIALIZED (SELECT * FROM {SYMBOLS} y) SELECT snapshot_id, 'directory' AS source_kind, parent_path AS source, 'directory' AS target_kind, path AS target FROM directories WHERE parent_path IS NOT NULL UNION ALL SELECT snapshot_id, 'directory', regexp_extract(path, '^(.*)/', 1), 'file', path FROM files
  UNION ALL SELECT a.snapshot_id, CASE WHEN b.fact IS NULL OR b.fact = a.fact THEN 'file' ELSE 'symbol' END, CASE WHEN b.fact IS NULL OR b.fact = a.fact THEN a.path ELSE b.fact END, 'symbol', a.fact FROM y a LEFT JOIN (SELECT * FROM y WHERE kind = 'class') b ON a.file_id = b.file_id)"""


@query("rel12", f"SELECT * FROM {CONTAINED} x")
def rel12_contains(t):
    return contains_edges(t("files"), _nested(t), t("directories")).select("snapshot_id", "source_kind", "source", "target_kind", "target")


@query("rel13", "SELECT p.snapshot_id, p.path AS parent, c.path AS child FROM directories p JOIN directories c ON c.snapshot_id = p.snapshot_id AND c.parent_path = p.path")
def rel13_directories(t):
    parents = t("directories").select("snapshot_id", F.col("path").alias("parent"))
    children = t("directories").select("snapshot_id", F.col("parent_path").alias("parent"), F.col("path").alias("child"))
    return parents.join(children, ["snapshot_id", "parent"]).select("snapshot_id", "parent", "child")


def build(t) -> DataFrame:
    """All edges of the derived snapshots."""
    symbols = _symbols(t)
    relative = resolve_imports(_imports(t), t("files")).withColumn("fact", F.col("path"))
    types = F.when(F.col("kind") == "class", F.array(F.lit("CALLS"), F.lit("EXTENDS"))).otherwise(F.array(F.lit("CALLS")))
    facts = symbols.where("callee <> ''").select("fact", "file_id", "snapshot_id", "path", "family", "callee", F.explode(types).alias("type"))
    return reduce(UNION, [
        contains_edges(t("files"), _nested(t), t("directories")), _edges_of(relative, "IMPORTS", "file", "file"), _edges_of(resolve_facts(facts, symbols), None), _edges_of(_exports(t), "EXPORTS", "file"),
    ])


_TYPES = ["class", "interface"]


def symbols_and_facts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and facts of files(snapshot_id, id, path, language, text); each text is read once.

    symbols: snapshot_id, file_id, path, family, fact (the reference), kind, name,
    start_line, start_column, start_at, end_at, parent, qualified_name. facts:
    snapshot_id, file_id, path, family, type, name, at, owner_at, around (the place
    of the function or method around it, of line and column).
    """
    family = F.when(F.col("language") == "java", "java").otherwise("script")
    rows = files.where("language is not null").select("snapshot_id", F.col("id").alias("file_id"), "path", "language", family.alias("family"), "text")
    own = ["snapshot_id", "file_id", "path", "family"]
    scanned = save(scan_files(rows, own), "scanned")
    ref, parent = (F.concat("path", F.lit("#"), line, F.lit(":"), column) for line, column in (("line", "column"), ("around_line", "around_column")))
    symbols = scanned.where("what = 'symbol'").select(*own, ref.alias("fact"), F.col("type").alias("kind"), "name", F.col("line").alias("start_line"), F.col("column").alias("start_column"), F.col("at").alias("start_at"), "end_at", parent.alias("parent"), "qualified_name")
    around = F.when(F.col("around_line").isNotNull(), F.struct(F.col("around_line").alias("line"), F.col("around_column").alias("column")))
    return symbols, scanned.where("what = 'fact'").select(*own, "type", "name", "at", "owner_at", around.alias("around"))


def build_from_text(files: DataFrame) -> DataFrame:
    """The whole graph of files(snapshot_id, id, path, language, text), with nothing else given."""
    symbols, facts = symbols_and_facts(files)
    return UNION(contains_edges(files, symbols, directory_chain(files)), resolve_text(files, symbols, facts))


def resolve_text(files: DataFrame, symbols: DataFrame, facts: DataFrame) -> DataFrame:
    """Edges of ``facts`` among all ``symbols`` and ``files``.

    A call comes from the innermost function or method around it, else from its
    file; heritage from the type that has it; imports and exports from the file.
    Equal facts of one source make one edge.
    """
    of = lambda *types: facts.where(F.col("type").isin(*types))
    own = ["snapshot_id", "file_id", "path", "family", "type"]

    spec = of("IMPORTS").select(*own, F.col("name").alias("spec")).distinct()
    script = resolve_imports(spec.where("family = 'script'"), files).withColumn("candidates", F.lit(None).cast("array<string>"))
    declared = symbols.where((F.col("family") == "java") & F.col("kind").isin(*_TYPES)).select("snapshot_id", "name", "path").distinct()
    java = resolve_dotted(spec.where("family = 'java'").select("snapshot_id", "file_id", "path", "spec"), declared)
    imports = script.unionByName(java.select(script.columns)).select("snapshot_id", "file_id", "path", F.lit("IMPORTS").alias("type"), F.col("path").alias("source"), F.lit("file").alias("source_kind"), F.lit("file").alias("kind"), "target", "state", "candidates", F.col("spec").alias("name"))

    # equal calls are found by numbers; the source is spelled out afterwards
    calls = of("CALLS").select(*own, F.col("name").alias("callee"), "around").distinct()
    calls = calls.select(*own, "callee", F.concat("path", F.lit("#"), "around.line", F.lit(":"), "around.column").alias("source"))

    heads = symbols.select("file_id", F.col("start_at").alias("owner_at"), F.col("fact").alias("source"))
    heritage = of("EXTENDS", "IMPLEMENTS").join(heads, ["file_id", "owner_at"]).select(*own, F.element_at(F.split("name", "\\."), -1).alias("callee"), "source").distinct()
    named_facts = resolve_facts(UNION(calls, heritage.select(calls.columns)), symbols)

    exports = resolve_exports(of("EXPORTS").select(*own, F.col("name").alias("callee")).distinct(), symbols).withColumns({"source": F.lit(None).cast("string"), "candidates": F.lit(None).cast("array<string>")})
    named = ["snapshot_id", "file_id", "path", "type", "source", "target", "state", "candidates", "callee"]
    between = reduce(UNION, (rows.select(named) for rows in (named_facts, exports)))
    to_symbols = between.select("snapshot_id", "file_id", "path", "type", F.coalesce("source", "path").alias("source"), F.when(F.col("source").isNull(), "file").otherwise("symbol").alias("source_kind"), F.lit("symbol").alias("kind"), "target", "state", "candidates", F.col("callee").alias("name"))
    found = UNION(imports, to_symbols).withColumn("target_kind", F.when(F.col("target").isNotNull(), F.col("kind")))
    return found.withColumn("key", edge_key(F.col("snapshot_id"), F.col("type"), F.col("source"), F.col("target"), F.col("name"))).select(EDGE)


def code_of(t) -> DataFrame:
    """Source files made of the documents' lines: imports, a type with its heritage, a method with a call for each line.

    The words are the documents'; ``w_`` keeps them apart from the languages' own.
    """
    files = t("files").join(t("extractions").where("language is not null").select(F.col("file_id").alias("id"), "language"), "id")
    word = lambda c: F.concat(F.lit("w_"), c)
    lines = t("text_lines").where("name <> '' and callee <> ''").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "name", "callee"))).alias("ls"))
    rows = files.join(lines.withColumnRenamed("file_id", "id"), "id", "left").withColumn("ls", F.coalesce("ls", F.array().cast("array<struct<start_line:bigint,name:string,callee:string>>")))
    k, first, second = F.col("doc_id"), F.get("ls", F.lit(0)), F.get("ls", F.lit(1))
    java = F.col("language") == "java"
    near = F.concat(F.lit("import { x } from './f"), k + 6, F.when(k % 4 == 0, ".js").otherwise(""), F.lit("';"))
    head = F.when(java, F.concat(F.lit("import w_"), first["callee"], F.lit(";"))).otherwise(near)
    kind = F.concat(F.when(java, "public class ").otherwise("export class "), word(first["name"]))
    heir = F.when(second.isNotNull(), F.concat(F.lit(" extends "), word(second["name"]), F.lit(" implements "), word(second["callee"]), F.lit(", "), word(first["callee"]))).otherwise("")
    body = lambda x: F.concat(F.when(java, "  public void ").otherwise("  "), word(x["name"]), F.lit('() { log("}"); '), word(x["callee"]), F.lit("(1); }"))
    code = F.concat_ws("\n", head, F.concat(kind, heir, F.lit(" {")), F.array_join(F.transform(F.slice("ls", F.lit(2), F.greatest(F.size("ls"), F.lit(1))), body), "\n"), F.lit("}"))
    path = F.when(java & first.isNotNull(), F.concat("lang", F.lit("/m"), k % 6, F.lit("/d"), k, F.lit("/w_"), first["name"], F.lit(".java"))).otherwise(F.col("path"))
    rows = rows.withColumn("lang", F.substring_index("path", "/", 1))
    return rows.select("snapshot_id", "id", path.alias("path"), "language", F.when(first.isNotNull(), code).otherwise("").alias("text"))


_CODE = f"""f AS MATERIALIZED (SELECT f.snapshot_id, f.id AS file_id, f.doc_id, e.language = 'java' AS java, f.path AS old, split_part(f.path, '/', 1) AS lang FROM files f JOIN extractions e ON e.file_id = f.id WHERE e.language IS NOT NULL),
  l AS MATERIALIZED (SELECT l.file_id, concat('w_', l.name) AS name, concat('w_', l.callee) AS callee, row_number() OVER (PARTITION BY l.file_id ORDER BY l.start_line) AS k FROM text_lines l JOIN f USING (file_id) WHERE l.name <> '' AND l.callee <> ''),
  c AS MATERIALIZED (SELECT f.snapshot_id, f.file_id, f.doc_id, f.java, f.lang, CASE WHEN f.java AND l.name IS NOT NULL THEN concat(f.lang, '/m', f.doc_id % 6, '/d', f.doc_id, '/', l.name, '.java') ELSE f.old END AS path, l.name AS class, l.callee AS word FROM f LEFT JOIN l ON l.file_id = f.file_id AND l.k = 1),
  y AS MATERIALIZED (SELECT snapshot_id, file_id, java, path, 'class' AS kind, class AS name, NULL AS callee, 1 AS line, concat(path, '#1:13') AS fact FROM c WHERE class IS NOT NULL UNION ALL SELECT c.snapshot_id, c.file_id, c.java, c.path, 'method', l.name, l.callee, l.k, concat(c.path, '#', l.k, CASE WHEN c.java THEN ':14' ELSE ':2' END) FROM c JOIN l USING (file_id) WHERE l.k > 1),
  r AS (SELECT snapshot_id, file_id, java, 'CALLS' AS type, fact AS source, callee AS name, 'method' AS kind FROM y WHERE kind = 'method' UNION SELECT snapshot_id, file_id, java, 'CALLS', fact, 'log', 'method' FROM y WHERE kind = 'method' UNION SELECT c.snapshot_id, file_id, java, 'EXTENDS', concat(path, '#1:13'), l.name, 'class' FROM c JOIN l USING (file_id) WHERE k = 2
    UNION SELECT c.snapshot_id, file_id, java, 'IMPLEMENTS', concat(path, '#1:13'), l.callee, 'class' FROM c JOIN l USING (file_id) WHERE k = 2 UNION SELECT c.snapshot_id, file_id, java, 'IMPLEMENTS', concat(path, '#1:13'), word, 'class' FROM c JOIN l USING (file_id) WHERE k = 2),
  a AS (SELECT file_id, kind, name, count(*) AS n, list(fact ORDER BY path, line) AS refs FROM y GROUP BY ALL), b AS (SELECT snapshot_id, java, kind, name, count(*) AS n, list(fact ORDER BY path, line) AS refs FROM y GROUP BY ALL),
  named AS (SELECT r.snapshot_id, r.type, r.source, CASE WHEN coalesce(a.n, b.n) = 1 THEN coalesce(a.refs, b.refs)[1] END AS target, CASE coalesce(a.n, b.n, 0) WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS state, r.name, CASE WHEN coalesce(a.n, b.n) > 1 THEN array_to_string(coalesce(a.refs, b.refs)[1:20], ',') END AS candidates
    FROM r LEFT JOIN a ON a.file_id = r.file_id AND a.kind = r.kind AND a.name = r.name LEFT JOIN b ON b.snapshot_id = r.snapshot_id AND b.java = r.java AND b.kind = r.kind AND b.name = r.name),
  tries AS (SELECT snapshot_id, file_id, path, spec, unnest(range(1, len(tries) + 1)) AS k, unnest(tries) AS candidate FROM (SELECT *, list_concat([base], [base || e for e in {SCRIPT_EXTENSIONS}], CASE WHEN doc_id % 4 = 0 THEN [replace(base, '.js', '') || e for e in {SCRIPT_SWAPS}] ELSE [] END, [base || '/index' || e for e in {SCRIPT_EXTENSIONS}]) AS tries
    FROM (SELECT *, concat(lang, '/m', doc_id % 6, substr(spec, 2)) AS base FROM (SELECT *, concat('./f', doc_id + 6, CASE WHEN doc_id % 4 = 0 THEN '.js' ELSE '' END) AS spec FROM c WHERE NOT java AND class IS NOT NULL) q) q) q),
  near AS (SELECT t.snapshot_id, t.path, t.spec, arg_min(g.path, t.k) AS target FROM tries t LEFT JOIN c g ON g.snapshot_id = t.snapshot_id AND g.path = t.candidate GROUP BY ALL),
  far AS (SELECT i.snapshot_id, i.path, i.word AS spec, count(g.path) AS n, min(g.path) AS target, array_to_string(list_sort(list(g.path) FILTER (WHERE g.path IS NOT NULL))[1:20], ',') AS paths FROM c i LEFT JOIN (SELECT * FROM c WHERE java AND class IS NOT NULL) g ON g.snapshot_id = i.snapshot_id AND g.class = i.word WHERE i.java AND i.class IS NOT NULL GROUP BY ALL),
  d AS (SELECT DISTINCT snapshot_id, array_to_string(parts[1:n - 1], '/') AS parent, array_to_string(parts[1:n], '/') AS path FROM (SELECT snapshot_id, parts, unnest(range(1, len(parts))) AS n FROM (SELECT snapshot_id, string_split(path, '/') AS parts FROM c) q) q),
  g AS (SELECT * FROM named UNION ALL SELECT snapshot_id, 'IMPORTS', path, target, CASE WHEN target IS NULL THEN 'UNKNOWN' ELSE 'RESOLVED' END, spec, NULL FROM near UNION ALL SELECT snapshot_id, 'IMPORTS', path, CASE WHEN n = 1 THEN target END, CASE n WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END, spec, CASE WHEN n > 1 THEN paths END FROM far
    UNION ALL SELECT snapshot_id, 'EXPORTS', path, fact, 'RESOLVED', name, NULL FROM y WHERE kind = 'class' AND NOT java UNION ALL SELECT snapshot_id, 'CONTAINS', parent, path, 'EXTRACTED', NULL, NULL FROM d UNION ALL SELECT snapshot_id, 'CONTAINS', regexp_extract(path, '^(.*)/', 1), path, 'EXTRACTED', NULL, NULL FROM c
    UNION ALL SELECT snapshot_id, 'CONTAINS', path, fact, 'EXTRACTED', NULL, NULL FROM y WHERE kind = 'class' UNION ALL SELECT snapshot_id, 'CONTAINS', concat(path, '#1:13'), fact, 'EXTRACTED', NULL, NULL FROM y WHERE kind = 'method')"""


TEXT_GRAPH = f"WITH {_CODE} SELECT snapshot_id, type, source, target, state, candidates, sha256(concat_ws(' ', snapshot_id, type, source, coalesce(target, '∅'), coalesce(name, '∅'))) AS key FROM g"


def source_files(t) -> DataFrame:
    """The made source files, written once."""
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))  # files take longer to scan than to read
    return t.saved("code", lambda: code_of(t).repartition(parts, "id"))


@query("rel14_text", TEXT_GRAPH)
def rel14_from_text(t):
    """The graph of source files, from their text alone."""
    return build_from_text(source_files(t)).select("snapshot_id", "type", "source", "target", "state", F.array_join("candidates", ",").alias("candidates"), "key")


_IMPORTED = f"(SELECT f.snapshot_id, f.path, arg_min(g.path, precedence) AS target FROM files f LEFT JOIN (SELECT x.file_id, g.path, precedence FROM {_TRY} x JOIN files g ON g.snapshot_id = x.snapshot_id AND g.path = candidate) g ON g.file_id = f.id GROUP BY 1, 2, f.id)"
GRAPH = f"""(SELECT snapshot_id, 'CONTAINS' AS type, source, target, 'EXTRACTED' AS state, NULL AS name, NULL AS cands FROM {CONTAINED} x UNION ALL SELECT snapshot_id, 'IMPORTS', path, target, CASE WHEN target IS NULL THEN 'UNKNOWN' ELSE 'RESOLVED' END, NULL, NULL FROM {_IMPORTED} i
  UNION ALL SELECT snapshot_id, 'CALLS', fact, target, state, callee, array_to_string(candidates, ',') FROM {CALLS} c UNION ALL SELECT snapshot_id, 'EXTENDS', fact, target, state, callee, array_to_string(candidates, ',') FROM {HERITAGE} h UNION ALL SELECT snapshot_id, 'EXPORTS', path, target, state, callee, NULL FROM (SELECT e.*, s.callee FROM {EXPORTS} e JOIN {SYMBOLS} s USING (fact, snapshot_id)) e)"""


@query("rel14", f"SELECT snapshot_id, type, source, target, state, sha256(concat_ws(' ', snapshot_id, type, source, coalesce(target, '∅'), coalesce(name, '∅'))) AS key FROM {GRAPH} g")
def rel14_graph(t):
    return build(t).select("snapshot_id", "type", "source", "target", "state", "key")


def _graph(t) -> DataFrame:
    """The edges for what reads them several times."""
    return t.saved("edges", lambda: build(t))


def canonical_lines(edges: DataFrame) -> DataFrame:
    """One line of text for each edge, free of row ids."""
    either = lambda c: F.coalesce(c, F.lit(NONE))
    line = F.concat_ws("|", F.lit("rel"), "type", "state", "source", either("target"), either("name"), F.coalesce(F.array_join(F.array_sort("candidates"), ","), F.lit("")))
    return edges.select("snapshot_id", line.alias("line"))


_LINE = "concat_ws('|', 'rel', type, state, source, coalesce(target, '∅'), coalesce(name, '∅'), coalesce(cands, ''))"


@query("rel15", f"SELECT snapshot_id, {_LINE.replace('cands', 'array_to_string(list_sort(string_split(cands, chr(44))), chr(44))')} AS line FROM {GRAPH} g")
def rel15_lines(t):
    return canonical_lines(build(t))


def _sums(lines: Column) -> list[Column]:
    """Four sums over the SHA-256 of texts, 60 bits of it in each."""
    part = lambda k: F.conv(F.substring(F.sha2(lines, 256), 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")
    return [F.sum(part(k)).cast("string").alias(f"s{k}") for k in range(4)]


def fingerprints(lines: DataFrame) -> DataFrame:
    """A hash for each snapshot that does not depend on the order of its lines.

    The lines' hashes are added up, so tasks combine them before the shuffle and
    none holds the lines of a snapshot; the number and the sums are hashed.
    """
    summed = lines.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("edges"), *_sums(F.col("line")))
    return summed.select("snapshot_id", F.sha2(F.concat_ws(":", F.col("edges").cast("string"), "s0", "s1", "s2", "s3"), 256).alias("fingerprint"), "edges")


_SUMS = ", ".join(f"sum(('0x' || substr(sha256(line), {15 * k + 1}, 15))::BIGINT)::VARCHAR AS s{k}" for k in range(4))


@query("rel16", f"SELECT snapshot_id, sha256(concat_ws(':', edges, s0, s1, s2, s3)) AS fingerprint, edges FROM (SELECT snapshot_id, count(*) AS edges, {_SUMS} FROM (SELECT snapshot_id, {_LINE.replace('cands', 'array_to_string(list_sort(string_split(cands, chr(44))), chr(44))')} AS line FROM {GRAPH} g) l GROUP BY 1) q")
def rel16_fingerprints(t):
    return fingerprints(canonical_lines(build(t)))


def node_lines(symbols: DataFrame, extractions: DataFrame, directories: DataFrame) -> DataFrame:
    """One line of text for each symbol, file and folder, free of row ids."""
    either = lambda c: F.coalesce(c, F.lit(NONE))
    return reduce(UNION, (
        symbols.select("snapshot_id", F.concat_ws("|", F.lit("sym"), "fact", "kind", "name", either("parent")).alias("line")),
        extractions.select("snapshot_id", F.concat_ws("|", F.lit("fe"), "path", "status", either("language")).alias("line")),
        directories.select("snapshot_id", F.concat_ws("|", F.lit("dir"), "path", either("parent_path")).alias("line")),
    ))


@query("rel15_nodes", f"WITH y AS MATERIALIZED (SELECT * FROM {SYMBOLS} y) SELECT a.snapshot_id, concat_ws('|', 'sym', a.fact, a.kind, a.name, CASE WHEN b.fact <> a.fact THEN b.fact ELSE '∅' END) AS line FROM y a LEFT JOIN (SELECT * FROM y WHERE kind = 'class') b ON b.file_id = a.file_id UNION ALL SELECT snapshot_id, concat_ws('|', 'fe', path, status, coalesce(language, '∅')) FROM extractions UNION ALL SELECT snapshot_id, concat_ws('|', 'dir', path, coalesce(parent_path, '∅')) FROM directories")
def rel15_nodes(t):
    return node_lines(_nested(t), t("extractions"), t("directories"))


@query("rel17", f"SELECT snapshot_id, concat(type, ' ', source, ' -> ', coalesce(target, '∅'), ' [', state, ']', CASE WHEN cands IS NOT NULL THEN concat(' cands=', array_to_string(list_sort(string_split(cands, ',')), '|')) ELSE '' END) AS line FROM {GRAPH} g WHERE type <> 'CONTAINS'")
def rel17_describe(t):
    cands = F.coalesce(F.concat(F.lit(" cands="), F.array_join(F.array_sort("candidates"), "|")), F.lit(""))
    return build(t).where("type <> 'CONTAINS'").select("snapshot_id", F.concat("type", F.lit(" "), "source", F.lit(" -> "), F.coalesce("target", F.lit(NONE)), F.lit(" ["), "state", F.lit("]"), cands).alias("line"))


def invariants(edges: DataFrame, symbols: DataFrame, files: DataFrame, directories: DataFrame) -> DataFrame:
    """Violations of each rule of a sound graph.

    Rules on single edges are one aggregate; all references are checked by one
    join; so the edges are read three times, however many rules there are.
    """
    state, size = F.col("state"), F.greatest(F.coalesce(F.size("candidates"), F.lit(0)), F.lit(0))
    single = {
        "open state with target": state.isin("AMBIGUOUS", "UNKNOWN") & F.col("target").isNotNull(),
        "settled state without target": state.isin("RESOLVED", "EXTRACTED") & F.col("target").isNull(),
        "candidates on a settled edge": (state != "AMBIGUOUS") & (size > 0),
        "ambiguous without candidates": (state == "AMBIGUOUS") & (size == 0),
        "ambiguous with fewer than two": (state == "AMBIGUOUS") & (size < 2),
        "too many candidates": size > CANDIDATES,
        "containment not extracted": (F.col("type") == "CONTAINS") & (state != "EXTRACTED"),
    }
    parts = [_rules(edges, single)]

    nodes = reduce(UNION, (rows.select("snapshot_id", F.lit(kind).alias("kind"), F.col(ref).alias("ref")) for kind, rows, ref in (("symbol", symbols, "fact"), ("file", files, "path"), ("directory", directories, "path"))))
    known = nodes.distinct().withColumn("known", F.lit(True))
    end = lambda rule, kind, ref: F.struct(rule.alias("rule"), kind.alias("kind"), ref.alias("ref"))
    ends = F.array(*(end(F.concat(F.lit(f"dangling {e} "), f"{e}_kind"), F.col(f"{e}_kind"), F.col(e)) for e in ("source", "target")))
    held = F.when(F.col("type") == "IMPORTS", "file").otherwise("symbol")
    others = F.when(state == "AMBIGUOUS", F.transform("candidates", lambda c: end(F.lit("dangling candidate"), held, c)))
    used = edges.select("snapshot_id", F.explode(F.concat(ends, F.coalesce(others, F.array().cast("array<struct<rule:string,kind:string,ref:string>>")))).alias("u")).select("snapshot_id", "u.*")
    orphans = directories.where("parent_path is not null").select("snapshot_id", F.lit("orphan directory").alias("rule"), F.lit("directory").alias("kind"), F.col("parent_path").alias("ref"))
    strays = symbols.select("snapshot_id", F.lit("extraction without file").alias("rule"), F.lit("file").alias("kind"), F.col("path").alias("ref")).distinct()
    used = reduce(UNION, [used.where("kind is not null"), orphans, strays])
    missing = used.join(known, ["snapshot_id", "kind", "ref"], "left").groupBy("rule").agg(F.count_if(F.col("known").isNull()).alias("violations"))
    names = edges.sparkSession.createDataFrame([(r,) for r in RULES if r.startswith(("dangling", "orphan", "extraction"))], "rule string")
    parts.append(names.join(missing, "rule", "left").select("rule", F.coalesce("violations", F.lit(0)).alias("violations")))

    kinds = symbols.select("snapshot_id", F.col("fact").alias("target"), "kind", F.col("family").alias("t_family"))
    families = symbols.select("file_id", "family").distinct()
    typed = edges.where("state = 'RESOLVED'").join(kinds, ["snapshot_id", "target"], "left").join(families, "file_id", "left")
    call, heritage, symbol = F.col("type") == "CALLS", F.col("type").isin("EXTENDS", "IMPLEMENTS"), F.col("target_kind") == "symbol"
    one_of = lambda *names: symbol & F.coalesce(F.col("kind").isin(*names), F.lit(True))  # noqa: E731 a dangling target is another rule's
    wrong = (call & ~one_of("function", "method")) | (heritage & ~one_of("class", "interface")) | ((F.col("type") == "IMPORTS") & (F.col("target_kind") != "file")) | ((F.col("type") == "EXPORTS") & ~symbol)
    crossing = symbol & (call | heritage) & (F.col("family") != F.col("t_family"))
    parts.append(_rules(typed, {"target of a wrong kind": wrong, "target of another family": crossing}))
    twice = symbols.groupBy("snapshot_id", "fact").agg(F.count(F.lit(1)).alias("n"))
    parts.append(_rules(twice, {"repeated symbol key": F.col("n") > 1}))
    return reduce(UNION, parts)


def _rules(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule: one aggregate for all."""
    counted = rows.agg(*(F.count_if(broken).alias(f"r{k}") for k, broken in enumerate(rules.values())))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(f"r{k}").alias("violations")) for k, rule in enumerate(rules)))).alias("r")).select("r.*")


RULES = [*(f"dangling {e} {k}" for e in ("source", "target") for k in ("symbol", "file", "directory")), "open state with target", "settled state without target", "candidates on a settled edge", "ambiguous without candidates", "ambiguous with fewer than two", "too many candidates", "dangling candidate", "repeated symbol key", "target of a wrong kind", "target of another family", "orphan directory", "containment not extracted", "extraction without file"]


@query("rel18", "SELECT rule, 0::BIGINT AS violations FROM (VALUES " + ", ".join(f"('{r}')" for r in RULES) + ") v(rule)")
def rel18_invariants(t):
    return invariants(_graph(t), _nested(t), t("files"), t("directories"))


#: damage that breaks some rules in a third of the snapshots each: (rule, edges, what becomes of their columns)
_DAMAGE = [
    ("open state with target", "state = 'UNKNOWN' AND snapshot_id % 3 = 0", {"target": "'nowhere'"}),
    ("dangling target symbol", "type = 'CALLS' AND state = 'RESOLVED' AND snapshot_id % 3 = 1", {"target": "'gone'"}),
    ("settled state without target", "type = 'EXTENDS' AND state = 'RESOLVED' AND snapshot_id % 3 = 2", {"target": "null", "target_kind": "null"}),
    ("containment not extracted", "type = 'CONTAINS' AND snapshot_id % 3 = 2", {"state": "'RESOLVED'"}),
    ("ambiguous with fewer than two", "state = 'AMBIGUOUS' AND snapshot_id % 3 < 2", {"candidates": "slice(candidates, 1, 1)"}),
    ("ambiguous without candidates", "state = 'AMBIGUOUS' AND snapshot_id % 3 = 1", {"candidates": "slice(candidates, 1, 0)"}),
]
_COUNTED = " UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) AS n FROM g WHERE {where}" for rule, where, _ in _DAMAGE)


@query("rel18_damaged", f"WITH g AS MATERIALIZED (SELECT * FROM {GRAPH} g), c AS ({_COUNTED}) SELECT v.rule, coalesce(n, 0)::BIGINT AS violations FROM (VALUES " + ", ".join(f"('{r}')" for r in RULES) + ") v(rule) LEFT JOIN c ON c.rule = v.rule")
def rel18_damaged(t):
    """The rules on a graph of which six kinds of edges are damaged."""
    edges = broken = _graph(t)
    for _, where, changes in _DAMAGE:
        broken = broken.withColumns({c: F.when(F.expr(where), F.expr(v).cast(edges.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()})
    return invariants(broken, _nested(t), t("files"), t("directories"))


def completeness(edges: DataFrame, symbols: DataFrame, files: DataFrame, directories: DataFrame) -> DataFrame:
    """How many symbols, files and folders do not have exactly one CONTAINS parent."""
    parents = edges.where("type = 'CONTAINS'").groupBy("snapshot_id", F.col("target_kind").alias("kind"), F.col("target").alias("ref")).agg(F.count(F.lit(1)).alias("n"))
    nodes = reduce(UNION, (rows.select("snapshot_id", F.lit(kind).alias("kind"), F.col(ref).alias("ref")) for kind, rows, ref in (("symbol", symbols, "fact"), ("file", files, "path"), ("directory", directories.where("parent_path is not null"), "path"))))
    joined = nodes.join(parents, ["snapshot_id", "kind", "ref"], "left")
    return joined.groupBy("kind").agg(F.count_if(F.coalesce("n", F.lit(0)) != 1).alias("violations"), F.count(F.lit(1)).alias("nodes"))


@query("rel19", f"SELECT 'symbol' AS kind, 0::BIGINT AS violations, (SELECT count(*) FROM {SYMBOLS} s) AS nodes UNION ALL SELECT 'file', 0, (SELECT count(*) FROM files) UNION ALL SELECT 'directory', 0, (SELECT count(*) FROM directories WHERE parent_path IS NOT NULL)")
def rel19_completeness(t):
    return completeness(_graph(t), _nested(t), t("files"), t("directories"))


@query("rel19_damaged", f"SELECT 'symbol' AS kind, count_if(snapshot_id % 3 = 1) AS violations, count(*) AS nodes FROM {SYMBOLS} s UNION ALL SELECT 'file', count_if(snapshot_id % 3 = 0), count(*) FROM files UNION ALL SELECT 'directory', 0, count(*) FROM directories WHERE parent_path IS NOT NULL")
def rel19_damaged(t):
    """Completeness of a graph in which files of some snapshots have lost their folder, and symbols of others have it twice."""
    edges = _graph(t).where("not (type = 'CONTAINS' and target_kind = 'file' and snapshot_id % 3 = 0)")
    twice = edges.where("type = 'CONTAINS' and target_kind = 'symbol' and snapshot_id % 3 = 1")
    return completeness(UNION(edges, twice), _nested(t), t("files"), t("directories"))


def graph_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """Lines that only one of two graphs has."""
    return UNION(base.exceptAll(head).withColumn("side", F.lit("missing")), head.exceptAll(base).withColumn("side", F.lit("extra")))


@query("rel20", f"WITH a AS (SELECT snapshot_id, fact, concat_ws('|', fact, state, coalesce(target, '∅')) AS line FROM {CALLS} c) SELECT snapshot_id, line, 'missing' AS side FROM a WHERE length(line) % 7 = 0 UNION ALL SELECT snapshot_id, concat(line, '+'), 'extra' FROM a WHERE length(line) % 7 = 0")
def rel20_diff(t):
    lines = _calls(t).select("snapshot_id", F.concat_ws("|", "fact", "state", F.coalesce("target", F.lit(NONE))).alias("line"))
    changed = lines.withColumn("line", F.when(F.length("line") % 7 == 0, F.concat("line", F.lit("+"))).otherwise(F.col("line")))
    return graph_diff(lines, changed)


def changed_files(base: DataFrame, head: DataFrame) -> DataFrame:
    """(snapshot_id, path) whose edges(path, key, state) differ, in any order, between two graphs."""
    keys = ["snapshot_id", "path"]
    line = F.concat_ws("|", "type", "key", "state")
    own = lambda edges, name: edges.where("path is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *_sums(line)).select(*keys, F.concat_ws(":", "n", "s0", "s1", "s2", "s3").alias(name))
    return own(base, "a").join(own(head, "b"), keys, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)


@query("rel20_files", f"SELECT DISTINCT snapshot_id, path FROM {CALLS} c WHERE length(fact) % 5 = 0 AND state = 'UNKNOWN'")
def rel20_files(t):
    """Files whose calls change where some open calls are settled."""
    edges = _edges_of(_calls(t), "CALLS")
    settled = edges.withColumn("state", F.when((F.length("source") % 5 == 0) & (F.col("state") == "UNKNOWN"), "EXTRACTED").otherwise(F.col("state")))
    return changed_files(edges, settled)


@query("rel21", f"SELECT v.type, s.state, count(g.source) AS n FROM (VALUES ('CONTAINS'), ('IMPORTS'), ('CALLS'), ('EXTENDS'), ('IMPLEMENTS'), ('EXPORTS')) v(type) CROSS JOIN (VALUES ('EXTRACTED'), ('RESOLVED'), ('AMBIGUOUS'), ('UNKNOWN')) s(state) LEFT JOIN {GRAPH} g ON g.type = v.type AND g.state = s.state GROUP BY 1, 2")
def rel21_counts(t):
    return edge_counts(build(t))


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges by type and state, 0 where there are none."""
    names = edges.sparkSession.createDataFrame([(k, s) for k in TYPES for s in ("EXTRACTED", "RESOLVED", "AMBIGUOUS", "UNKNOWN")], "type string, state string")
    counts = edges.groupBy("type", "state").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, ["type", "state"], "left").select("type", "state", F.coalesce("n", F.lit(0)).alias("n"))


def totals(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols, edges, candidates and files of each snapshot."""
    n = F.count(F.lit(1))
    parts = [symbols.groupBy("snapshot_id").agg(n.alias("symbols")), edges.groupBy("snapshot_id").agg(n.alias("edges"), F.sum(F.greatest(F.coalesce(F.size("candidates"), F.lit(0)), F.lit(0))).cast("long").alias("candidates")), files.groupBy("snapshot_id").agg(n.alias("files"))]
    joined = reduce(lambda a, b: a.join(b, "snapshot_id", "full_outer"), parts)
    return joined.select("snapshot_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("symbols", "edges", "candidates", "files")))


@query("rel21_totals", f"SELECT snapshot_id, coalesce(y, 0) AS symbols, coalesce(e, 0) AS edges, coalesce(c, 0)::BIGINT AS candidates, coalesce(f, 0) AS files FROM (SELECT snapshot_id, count(*) AS y FROM {SYMBOLS} s GROUP BY 1) a FULL JOIN (SELECT snapshot_id, count(*) AS e, sum(CASE WHEN cands IS NULL THEN 0 ELSE len(string_split(cands, ',')) END) AS c FROM {GRAPH} g GROUP BY 1) b USING (snapshot_id) FULL JOIN (SELECT snapshot_id, count(*) AS f FROM extractions GROUP BY 1) x USING (snapshot_id)")
def rel21_totals(t):
    return totals(_graph(t), _symbols(t), t("extractions"))


@query("rel22", f"""WITH g AS MATERIALIZED (SELECT *, sha256(concat_ws(' ', snapshot_id, type, source, coalesce(target, '∅'), coalesce(name, '∅'))) AS key FROM {GRAPH} g), w AS (SELECT snapshot_id, path AS ref FROM files), u AS (SELECT w.ref, 'out' AS side, key, state, cands, w.snapshot_id FROM g JOIN w ON w.snapshot_id = g.snapshot_id AND w.ref = g.source UNION ALL SELECT w.ref, 'in', key, state, cands, w.snapshot_id FROM g JOIN w ON w.snapshot_id = g.snapshot_id AND w.ref = g.target)
    SELECT ref, side, key, CASE WHEN state = 'AMBIGUOUS' THEN len(string_split(cands, ','))::INTEGER END AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, ref, side ORDER BY key) AS k FROM u) q WHERE k <= 100""")
def rel22_relationships(t):
    """The first page of every file on both sides, from an edge store."""
    path = new_path(t.spark, "edge-store")
    write_edges(build(t), path)
    found = pages(read_edges(t.spark, path), t("files").select("snapshot_id", F.col("path").alias("ref")))
    return found.select("ref", "side", "key", F.size("candidates").alias("candidates"))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges into and out of every node, all and calls only."""
    call = (F.col("type") == "CALLS").cast("long")
    ends = F.array(F.struct(F.col("source").alias("ref"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("target").alias("ref"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    rows = edges.select("snapshot_id", call.alias("call"), F.explode(ends).alias("e")).select("snapshot_id", "call", "e.*").where("ref is not null")
    return rows.groupBy("snapshot_id", "ref").agg(F.sum("out").alias("out_degree"), F.sum("into").alias("in_degree"), F.sum(F.col("into") * F.col("call")).alias("called"))


@query("rel23", f"WITH e AS (SELECT snapshot_id, source AS ref, 1 AS o, 0 AS i, 0 AS c FROM {GRAPH} g UNION ALL SELECT snapshot_id, target, 0, 1, CASE WHEN type = 'CALLS' THEN 1 ELSE 0 END FROM {GRAPH} g WHERE target IS NOT NULL) SELECT snapshot_id, ref, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(c)::BIGINT AS called FROM e GROUP BY 1, 2")
def rel23_degrees(t):
    return degrees(build(t))


def degree_statistics(nodes: DataFrame) -> DataFrame:
    """For each snapshot and direction over nodes that have edges in it: number, statistics, the node with most (the least name on ties)."""
    sides = F.array(*(F.struct(F.lit(side).alias("side"), F.col(c).alias("n")) for side, c in (("out", "out_degree"), ("in", "in_degree"), ("called", "called"))))
    each = nodes.select("snapshot_id", "ref", F.explode(sides).alias("e")).select("snapshot_id", "ref", "e.*").where("n > 0")
    each = save(each, "degrees")
    n = F.col("n")
    plain = each.groupBy("snapshot_id", "side").agg(F.count(n).alias("nodes"), F.min(n).alias("low"), F.max(n).alias("high"), F.round(F.avg(n), 6).alias("mean"), F.min_by("ref", F.struct(-n, "ref")).alias("hub"))
    ordered = middle_and_p95(each, ["snapshot_id", "side"], "n").drop("n")
    return plain.join(ordered, ["snapshot_id", "side"]).select("snapshot_id", "side", "nodes", "low", "mid", "p95", "high", "mean", "hub")


@query("rel23_hubs", f"""WITH e AS (SELECT snapshot_id, source AS ref, 1 AS o, 0 AS i, 0 AS c FROM {GRAPH} g UNION ALL SELECT snapshot_id, target, 0, 1, CASE WHEN type = 'CALLS' THEN 1 ELSE 0 END FROM {GRAPH} g WHERE target IS NOT NULL), d AS (SELECT snapshot_id, ref, sum(o)::BIGINT AS o, sum(i)::BIGINT AS i, sum(c)::BIGINT AS c FROM e GROUP BY 1, 2),
    s AS (SELECT snapshot_id, ref, 'out' AS side, o AS n FROM d UNION ALL SELECT snapshot_id, ref, 'in', i FROM d UNION ALL SELECT snapshot_id, ref, 'called', c FROM d)
    SELECT snapshot_id, side, count(*) AS nodes, min(n) AS low, median(n) AS mid, quantile_disc(n, 0.95) AS p95, max(n) AS high, round(avg(n), 6) AS mean, arg_min(ref, (-n, ref)) AS hub FROM s WHERE n > 0 GROUP BY 1, 2""")
def rel23_hubs(t):
    return degree_statistics(degrees(_graph(t)))


from lithic.operators.snapshots import JOBS, job_states  # noqa: E402


def rollup(jobs: DataFrame) -> DataFrame:
    """State of each snapshot's extraction from its jobs."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s)) > 0
    return jobs.groupBy("snapshot_id").agg(F.when(is_("pending", "retrying"), "in_progress").when(is_("failed"), "completed_partial").otherwise("completed").alias("status"))


@query("rel24", f"SELECT snapshot_id, CASE WHEN bool_or(status IN ('pending', 'retrying')) THEN 'in_progress' WHEN bool_or(status = 'failed') THEN 'completed_partial' ELSE 'completed' END AS status FROM {JOBS} GROUP BY 1")
def rel24_rollup(t):
    return rollup(job_states(t("job_events")))


@query("rel25", f"SELECT snapshot_id, CASE WHEN snapshot_id % 9 = 0 THEN 'PAUSED' WHEN bool_or(status = 'failed') THEN 'FAILED' WHEN bool_and(status = 'completed') THEN 'GRAPHIFIED' WHEN bool_and(status = 'pending' AND retry_count = 0) THEN 'QUEUED' ELSE 'ANALYZING' END AS state FROM {JOBS} GROUP BY 1")
def rel25_lifecycle(t):
    jobs = job_states(t("job_events"))
    return lifecycle(jobs, jobs.where("snapshot_id % 9 = 0").select("snapshot_id").distinct())


def lifecycle(jobs: DataFrame, paused: DataFrame) -> DataFrame:
    """Where each snapshot stands, unless it is paused."""
    every = lambda c: F.bool_and(c)
    state = F.when(F.bool_or(F.col("status") == "failed"), "FAILED").when(every(F.col("status") == "completed"), "GRAPHIFIED").when(every((F.col("status") == "pending") & (F.col("retry_count") == 0)), "QUEUED").otherwise("ANALYZING")
    joined = jobs.groupBy("snapshot_id").agg(state.alias("state")).join(paused.withColumn("paused", F.lit(True)), "snapshot_id", "left")
    return joined.select("snapshot_id", F.when(F.col("paused"), "PAUSED").otherwise(F.col("state")).alias("state"))


@query("rel26", "SELECT id FROM files WHERE NOT (id % 3 = 0 AND id % 2 = 0)")
def rel26_short_circuit(t):
    done = t("files").where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "2").otherwise("1").alias("version"))
    return pending_units(t("files").select("id"), done, "2")


def pending_units(units: DataFrame, checkpoints: DataFrame, version: str) -> DataFrame:
    """Units without a checkpoint of the current version."""
    return units.join(checkpoints.where(F.col("version") == version).select("id"), "id", "left_anti")


@query("rel27", "SELECT event_type, count(*) AS n, round(min(value), 9) AS low, round(median(value), 9) AS mid, round(quantile_disc(value, 0.95), 9) AS p95, round(max(value), 9) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(stddev_pop(value) / avg(value), 6) AS cv FROM events GROUP BY 1")
def rel27_stats(t):
    return sample_stats(t("events"), "event_type", "value")


def sample_stats(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Number, extremes, middle, 95th percentile, mean, deviation and coefficient of variation of each group."""
    v = F.col(value)
    stats = rows.groupBy(key).agg(F.round(F.min(v), 9).alias("low"), F.round(F.max(v), 9).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))
    ordered = middle_and_p95(rows, [key], value).withColumnRenamed(key, "_key")
    joined = stats.join(ordered, F.col(key).eqNullSafe(F.col("_key")))
    return joined.select(key, "n", "low", F.round("mid", 9).alias("mid"), F.round("p95", 9).alias("p95"), "high", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(F.col("sd") / F.col("mean"), 6).alias("cv"))


@query("rel28", "SELECT user_id, round(coalesce(regr_slope(value, event_id), 0), 9) AS slope FROM events GROUP BY 1")
def rel28_slope(t):
    return t("events").groupBy("user_id").agg(F.round(F.coalesce(F.regr_slope("value", "event_id"), F.lit(0.0)), 9).alias("slope"))


@query("rel29", f"SELECT unit_index, status, count(*) AS n, CASE WHEN sum(count(*)) OVER (PARTITION BY unit_index) > 0 THEN sum(count(*)) OVER (PARTITION BY unit_index) END::BIGINT AS total FROM {JOBS} GROUP BY 1, 2")
def rel29_progress(t):
    counts = job_states(t("job_events")).groupBy("unit_index", "status").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(W.partitionBy("unit_index")))
