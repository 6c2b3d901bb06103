"""Symbols of source files: languages, directories, declarations, nesting, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic.operators.code import scan_files
from lithic.operators.ordering import number_rows
from lithic.operators.snapshots import JOBS, job_states, keyset_page
from lithic.registry import query
from lithic.saved import drop_saved, save

# ---- fixed values
LANGUAGES = {"java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx"}
SIZE_CEILING = 10 << 20
VERSION = "1"
UNIT = 50


def language_of(path: Column) -> Column:
    """Language by the text after the last dot of the whole path."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.when(F.contains(path, F.lit(".")), F.element_at(table, F.lower(F.substring_index(path, ".", -1))))


@query("sym1", "SELECT id, CASE CASE WHEN contains(path, '.') THEN lower(regexp_extract(path, '\\.([^.]*)$', 1)) END " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in LANGUAGES.items()) + " END AS language FROM files")
def sym1_language(t):
    return t("files").select("id", language_of(F.col("path")).alias("language"))


def directory_chain(files: DataFrame) -> DataFrame:
    """Every folder above a file, the root included, with its parent."""
    parts = F.split("path", "/")
    depth = F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("depth")
    rows = files.select("snapshot_id", parts.alias("parts"), depth)
    join = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/")
    return rows.select("snapshot_id", join(F.col("depth")).alias("path"), F.when(F.col("depth") > 0, join(F.col("depth") - 1)).alias("parent_path")).distinct()


@query("sym2", "SELECT snapshot_id, path, parent_path FROM directories")
def sym2_directories(t):
    return directory_chain(t("files"))


def gate(files: DataFrame, ceiling: int = SIZE_CEILING) -> DataFrame:
    """Extraction status and reason of files(path, size_bytes, content, parsed)."""
    language = language_of(F.col("path"))
    big = F.col("size_bytes") > ceiling
    reason = (
        F.when(language.isNull(), None)
        .when(big, F.concat(F.lit("exceeds size ceiling ("), F.col("size_bytes").cast("string"), F.lit(f" > {ceiling} bytes)")))
        .when(F.col("content").isNull(), "object missing")
        .when(~F.is_valid_utf8(F.col("content").cast("string")), "not valid UTF-8")
        .when(~F.col("parsed"), "parse produced syntax errors")
    )
    status = F.when(language.isNull() | big, "skipped_unsupported").when(reason.isNotNull(), "failed").otherwise("extracted")
    return files.withColumns({"status": status, "failure_reason": reason})


@query("sym3", "SELECT id, CASE WHEN l IS NULL OR size_bytes > 10485760 THEN 'skipped_unsupported' WHEN id % 11 = 0 OR id % 13 = 0 THEN 'failed' ELSE 'extracted' END AS status, CASE WHEN l IS NULL THEN NULL WHEN size_bytes > 10485760 THEN concat('exceeds size ceiling (', size_bytes, ' > 10485760 bytes)') WHEN id % 11 = 0 THEN 'object missing' WHEN id % 13 = 0 THEN 'parse produced syntax errors' END AS failure_reason FROM (SELECT id, size_bytes, CASE WHEN contains(path, '.') AND lower(regexp_extract(path, '\\.([^.]*)$', 1)) IN ('java','js','jsx','mjs','cjs','ts','mts','cts','tsx') THEN 1 END AS l FROM files) q")
def sym3_gate(t):
    rows = t("files").select("id", "path", "size_bytes", F.when(F.col("id") % 11 != 0, F.col("text")).alias("content"), (F.col("id") % 13 != 0).alias("parsed"))
    return gate(rows).select("id", "status", "failure_reason")


def declarations(files: DataFrame) -> DataFrame:
    """Declared symbols of files(file_id, language, text): kind, name, span in lines and place in the line.

    Every declaration counts, however many share a line. One ends at the line of
    the brace that closes its body; without a body it ends where it starts.
    """
    found = scan_files(files.where("language is not null"), ["file_id"]).where("what = 'symbol'")
    return found.select("file_id", F.col("type").alias("kind"), "name", F.col("line").alias("start_line"), F.col("column").alias("start_column"), "end_line")


@query("sym4", """WITH l AS (SELECT file_id, e.language, coalesce(nullif(name, ''), 'x') AS name, row_number() OVER (PARTITION BY file_id ORDER BY start_line) AS k, count(*) OVER (PARTITION BY file_id) AS n FROM text_lines JOIN extractions e USING (file_id) WHERE e.language IS NOT NULL)
    SELECT file_id, 'class' AS kind, name, 0::BIGINT AS start_line, n AS end_line FROM l WHERE k = 1 UNION ALL SELECT file_id, CASE WHEN language = 'java' THEN 'method' ELSE 'function' END, name, k - 1, k - 1 FROM l WHERE k > 1""")
def sym4_declarations(t):
    """Declarations in code made of the documents' lines: a class around one function a line."""
    rows = t("text_lines").join(t("extractions").where("language is not null").select("file_id", "language"), "file_id")
    name = F.when(F.col("name") == "", "x").otherwise(F.col("name"))
    rows = rows.select("file_id", "language", F.struct("start_line", name.alias("name"), "callee").alias("l")).groupBy("file_id", "language").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    body = lambda x: F.when(F.col("language") == "java", F.concat(F.lit("  public void "), x["name"], F.lit('() { call("}"); }'))).otherwise(F.concat(F.lit("  function "), x["name"], F.lit("() { return '{'; } // }")))
    code = F.array_join(F.concat(F.array(F.concat(F.lit("class "), F.get("ls", F.lit(0))["name"], F.lit(" {"))), F.transform(F.slice("ls", F.lit(2), F.size("ls")), body), F.array(F.lit("}"))), "\n")
    found = declarations(rows.select("file_id", "language", code.alias("text")))
    return found.select("file_id", "kind", "name", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


def dyadic_nodes(start: Column, end: Column) -> Column:
    """The fewest stretches (level, place) of 2**level positions that make up the positions from start to end.

    There are at most two at a level, so at most twice the logarithm of the end.
    """
    behind = end + 1
    shifted = lambda x, k: F.floor(x / F.pow(F.lit(2.0), k)).cast("long")

    def at(k: Column) -> Column:
        low, high = -shifted(-start, k), shifted(behind, k)
        node = lambda x: F.struct(k.cast("int").alias("level"), x.alias("place"))
        left = F.when((low < high) & (F.pmod(low, F.lit(2)) == 1), node(low))
        right = F.when((low < high) & (F.pmod(high, F.lit(2)) == 1), node(high - 1))
        return F.array(left, right)

    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(behind, F.lit(1)) + 1)).cast("int"))
    return F.array_compact(F.flatten(F.transform(levels, at)))


def around_points(points: DataFrame, at: str, spans: DataFrame) -> DataFrame:
    """points(file_id, ...) beside each of spans(file_id, start_at, end_at, ...) of their file that covers position ``at``.

    A span lies at its few nodes of a tree of stretches, a point looks at the
    stretches around it on the levels that its file uses: each span that covers
    it is met once, and no span is copied along its length.
    """
    placed = spans.withColumn("_node", F.explode(dyadic_nodes(F.col("start_at"), F.greatest("start_at", "end_at"))))
    levels = placed.groupBy("file_id").agg(F.collect_set("_node.level").alias("_levels"))  # some 60 at most
    asking = points.join(levels, "file_id").withColumn("_level", F.explode("_levels")).drop("_levels")
    asking = asking.withColumn("_place", F.floor(F.col(at) / F.pow(F.lit(2.0), F.col("_level"))).cast("long"))
    placed = placed.select("*", F.col("_node.level").alias("_level"), F.col("_node.place").alias("_place")).drop("_node", "start_at", "end_at")
    return asking.join(placed, ["file_id", "_level", "_place"]).drop("_level", "_place")


def nest(symbols: DataFrame) -> DataFrame:
    """Parent and qualified name of symbols(file_id, symbol, name, start_at, end_at) by containment.

    The enclosing symbols of a symbol are those of its file that begin no later
    and end no earlier; the nearest begins last. They are found as the spans
    around the position where the symbol begins.
    """
    outer = symbols.select("file_id", F.col("symbol").alias("o"), F.col("name").alias("o_name"), "start_at", "end_at", F.col("start_at").alias("o_start"), F.col("end_at").alias("o_end"))
    wider = (F.col("o_start") < F.col("start_at")) & (F.col("o_end") >= F.col("end_at")) | (F.col("o_start") == F.col("start_at")) & (F.col("o_end") > F.col("end_at"))
    pairs = around_points(symbols, "start_at", outer).where(wider)
    around = pairs.groupBy("file_id", "symbol").agg(
        F.max_by("o", F.struct("o_start", -F.col("o_end"), "o")).alias("parent"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_start", (-F.col("o_end")).alias("e"), "o", "o_name"))), lambda x: x["o_name"]), ".").alias("outer_names"),
    )
    joined = symbols.join(around, ["file_id", "symbol"], "left")
    return joined.select("file_id", "symbol", "parent", F.when(F.col("outer_names").isNotNull(), F.concat_ws(".", "outer_names", "name")).alias("qualified_name"))


_SPANS = "(SELECT user_id AS file_id, event_id AS symbol, concat('s', event_id % 100) AS name, start_at, end_at FROM spans WHERE end_at > start_at) s"


@query("sym5", f"""WITH s AS MATERIALIZED (SELECT * FROM {_SPANS}), p AS (SELECT a.symbol, b.symbol AS o, b.name AS n, b.start_at AS x, b.end_at AS y FROM s a JOIN s b ON a.file_id = b.file_id AND ((b.start_at < a.start_at AND b.end_at >= a.end_at) OR (b.start_at = a.start_at AND b.end_at > a.end_at))),
    g AS (SELECT symbol, arg_max(o, (x, -y, o)) AS parent, string_agg(n, '.' ORDER BY x, -y, o) AS names FROM p GROUP BY 1) SELECT file_id, symbol, parent, CASE WHEN names IS NOT NULL THEN concat(names, '.', name) END AS qualified_name FROM s LEFT JOIN g USING (symbol)""")
def sym5_nest(t):
    rows = t("spans").where("end_at > start_at")
    return nest(rows.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("symbol"), F.concat(F.lit("s"), F.col("event_id") % 100).alias("name"), "start_at", "end_at"))


def symbol_key(snapshot: Column, path: Column, kind: Column, name: Column, line: Column, column: Column) -> Column:
    return F.sha2(F.concat_ws(" ", snapshot.cast("string"), path, kind, name, line.cast("string"), column.cast("string")), 256)


@query("sym6", "SELECT file_id, start_line, sha256(concat_ws(' ', snapshot_id, path, kind, name, start_line, 0)) AS symbol_key FROM text_lines")
def sym6_key(t):
    return t("text_lines").select("file_id", "start_line", symbol_key(*(F.col(c) for c in ("snapshot_id", "path", "kind", "name", "start_line")), F.lit(0)).alias("symbol_key"))


def replace_file_symbols(stored: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """Stored symbols with those of the touched files replaced; a touched file without new symbols ends empty."""
    return stored.join(touched.select("file_id").distinct(), "file_id", "left_anti").unionByName(fresh.join(touched.select("file_id").distinct(), "file_id", "left_semi"))


@query("sym7", "SELECT file_id, start_line, name FROM text_lines WHERE file_id % 3 <> 0 UNION ALL SELECT file_id, start_line, concat(name, '2') FROM text_lines WHERE file_id % 6 = 0")
def sym7_replace(t):
    rows = t("text_lines").select("file_id", "start_line", "name")
    fresh = rows.where("file_id % 6 = 0").withColumn("name", F.concat("name", F.lit("2")))
    return replace_file_symbols(rows, fresh, rows.where("file_id % 3 = 0"))


def resolve_parents(symbols: DataFrame) -> DataFrame:
    """symbols(file_id, id, symbol_key, parent_key, ...) with the parent's id, looked up inside the file; ``unresolved`` where there is none."""
    parents = symbols.groupBy("file_id", F.col("symbol_key").alias("parent_key")).agg(F.max("id").alias("parent_id"))
    joined = symbols.join(parents, ["file_id", "parent_key"], "left")
    return joined.select(*symbols.columns, "parent_id", (F.col("parent_key").isNotNull() & F.col("parent_id").isNull()).alias("unresolved"))


def checked_parents(symbols: DataFrame) -> DataFrame:
    """``resolve_parents``, but a parent that is not in the symbol's own file is an error."""
    found = save(resolve_parents(symbols), "parents")
    lost = found.where("unresolved").select("file_id", "symbol_key", "parent_key").head(1)
    if lost:
        raise ValueError(f"parent {lost[0].parent_key!r} of {lost[0].symbol_key!r} is not among the symbols of file {lost[0].file_id}")
    return found.drop("unresolved")


@query("sym7_parents", "WITH s AS (SELECT file_id, file_id * 100000 + start_line AS id, concat(path, '#', start_line) AS symbol_key, min(start_line) OVER (PARTITION BY file_id) AS head, start_line, path FROM text_lines) SELECT file_id, id, CASE WHEN start_line <> head THEN file_id * 100000 + head END AS parent_id FROM s")
def sym7_parents(t):
    """Every line's parent is its file's first line."""
    rows = t("text_lines").select("file_id", "path", "start_line", (F.col("file_id") * 100_000 + F.col("start_line")).alias("id"), F.concat("path", F.lit("#"), "start_line").alias("symbol_key"))
    heads = rows.groupBy("file_id").agg(F.min_by("symbol_key", "start_line").alias("head"))
    keyed = rows.join(heads, "file_id").withColumn("parent_key", F.when(F.col("head") != F.col("symbol_key"), F.col("head")))
    return checked_parents(keyed.select("file_id", "id", "symbol_key", "parent_key")).select("file_id", "id", "parent_id")


@query("sym8", "SELECT snapshot_id, unit_index AS file, arg_max(event, event_id) AS status FROM job_events GROUP BY 1, 2")
def sym8_upsert(t):
    return t("job_events").groupBy("snapshot_id", F.col("unit_index").alias("file")).agg(F.max_by("event", "event_id").alias("status"))


def _symbol_counts(t) -> DataFrame:
    return t("text_lines").groupBy("file_id").agg(F.count(F.lit(1)).alias("symbols"))


@query("sym9", "SELECT f.id, coalesce(e.status, 'not_attempted') AS status, CASE WHEN e.status = 'extracted' THEN coalesce(s.n, 0) ELSE 0 END AS symbols FROM files f LEFT JOIN extractions e ON e.file_id = f.id LEFT JOIN (SELECT file_id, count(*) AS n FROM text_lines GROUP BY 1) s ON s.file_id = f.id")
def sym9_detail(t):
    return file_details(t("files").select(F.col("id").alias("file_id")), t("extractions"), _symbol_counts(t)).select(F.col("file_id").alias("id"), "status", "symbols")


def file_details(files: DataFrame, extractions: DataFrame, counts: DataFrame) -> DataFrame:
    """Status, language, reason and symbol count of every file; files that were not tried say so."""
    joined = files.join(extractions.select("file_id", "status", "language", "failure_reason"), "file_id", "left").join(counts, "file_id", "left")
    symbols = F.when(F.col("status") == "extracted", F.coalesce("symbols", F.lit(0))).otherwise(0)
    return joined.withColumns({"status": F.coalesce("status", F.lit("not_attempted")), "symbols": symbols})


@query("sym10", "SELECT file_id, start_line FROM text_lines WHERE snapshot_id = 2 AND kind = 'function' AND starts_with(path, 'en/') AND file_id * 100000 + start_line > 5000000 ORDER BY file_id * 100000 + start_line LIMIT 50")
def sym10_page(t):
    rows = t("text_lines").where("snapshot_id = 2 and kind = 'function'").where(F.startswith("path", F.lit("en/")))
    page = keyset_page(rows.select((F.col("file_id") * 100_000 + F.col("start_line")).alias("id"), "file_id", "start_line"), 5_000_000, 50)
    return page.select("file_id", "start_line")


@query("sym11", "SELECT l.file_id, l.start_line, f.content_hash, s.commit_sha, s.repository_id FROM text_lines l JOIN files f ON f.id = l.file_id JOIN snapshots s ON s.id = l.snapshot_id WHERE l.kind = 'class'")
def sym11_provenance(t):
    return provenance(t("text_lines").where("kind = 'class'"), t("files"), t("snapshots")).select("file_id", "start_line", "content_hash", "commit_sha", "repository_id")


def provenance(symbols: DataFrame, files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each symbol with its file's content, and its snapshot's commit and repository."""
    return symbols.join(files.select(F.col("id").alias("file_id"), "content_hash"), "file_id").join(snapshots.select(F.col("id").alias("snapshot_id"), "commit_sha", "repository_id"), "snapshot_id")


def extraction_summary(extractions: DataFrame, counts: DataFrame) -> DataFrame:
    """Files by status and symbols of each snapshot."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    joined = extractions.join(counts, "file_id", "left")
    symbols = F.coalesce(F.sum(F.when(F.col("status") == "extracted", F.col("symbols"))), F.lit(0))
    return joined.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("files"), is_("extracted").alias("extracted"), is_("skipped_unsupported").alias("skipped"), is_("failed").alias("failed"), symbols.alias("symbols"))


_EXTRACTED = "(SELECT e.snapshot_id, count(*) AS files, count(*) FILTER (WHERE status = 'extracted') AS extracted, count(*) FILTER (WHERE status = 'skipped_unsupported') AS skipped, count(*) FILTER (WHERE status = 'failed') AS failed, coalesce(sum(n) FILTER (WHERE status = 'extracted'), 0)::BIGINT AS symbols FROM extractions e LEFT JOIN (SELECT file_id, count(*) AS n FROM text_lines GROUP BY 1) s ON s.file_id = e.file_id GROUP BY 1)"


@query("sym12", f"SELECT * FROM {_EXTRACTED} x")
def sym12_summary(t):
    return extraction_summary(t("extractions"), _symbol_counts(t))


@query("sym13", f"SELECT s.id, CASE WHEN x.snapshot_id IS NULL THEN 'not_started' WHEN s.status <> 'completed' THEN 'in_progress' WHEN skipped + failed > 0 THEN 'completed_partial' ELSE 'completed' END AS status, coalesce(files, 0) AS files, coalesce(symbols, 0) AS symbols FROM snapshots s LEFT JOIN {_EXTRACTED} x ON x.snapshot_id = s.id")
def sym13_status(t):
    return extraction_status(t("snapshots"), extraction_summary(t("extractions"), _symbol_counts(t)))


def extraction_status(snapshots: DataFrame, summary: DataFrame) -> DataFrame:
    joined = snapshots.select("id", F.col("status").alias("snapshot_status")).join(summary, F.col("id") == F.col("snapshot_id"), "left")
    status = F.when(F.col("files").isNull(), "not_started").when(F.col("snapshot_status") != "completed", "in_progress").when(F.col("skipped") + F.col("failed") > 0, "completed_partial").otherwise("completed")
    return joined.select("id", status.alias("status"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("symbols", F.lit(0)).alias("symbols"))


@query("sym14", "SELECT id, CASE WHEN status <> 'completed' THEN 'not_extractable' WHEN id % 4 = 0 THEN 'reuse' WHEN id % 4 = 1 AND id % 3 = 0 THEN 'reuse' ELSE 'restart' END AS action FROM snapshots")
def sym14_reuse(t):
    state = F.when(F.col("id") % 4 == 0, "in_progress").when(F.col("id") % 4 == 1, "completed_partial").otherwise("failed")
    rows = t("snapshots").select("id", "status", state.alias("extraction"), F.when(F.col("id") % 3 == 0, VERSION).otherwise("0").alias("version"))
    return rows.select("id", reuse_or_restart(VERSION).alias("action"))


def reuse_or_restart(version: str) -> Column:
    """What a request for extraction does with rows(status, extraction, version)."""
    done = F.col("extraction").isin("completed", "completed_partial") & (F.col("version") == version)
    return F.when(F.col("status") != "completed", "not_extractable").when((F.col("extraction") == "in_progress") | done, "reuse").otherwise("restart")


@query("sym15", f"SELECT x.snapshot_id, CASE WHEN j.bad > 0 THEN 'failed' WHEN skipped + failed > 0 THEN 'completed_partial' ELSE 'completed' END AS status FROM {_EXTRACTED} x LEFT JOIN (SELECT snapshot_id, count(*) FILTER (WHERE status = 'failed') AS bad FROM {JOBS} GROUP BY 1) j USING (snapshot_id)")
def sym15_finalize(t):
    bad = job_states(t("job_events")).groupBy("snapshot_id").agg(F.count_if(F.col("status") == "failed").alias("bad"))
    joined = extraction_summary(t("extractions"), _symbol_counts(t)).join(bad, "snapshot_id", "left")
    return joined.select("snapshot_id", F.when(F.col("bad") > 0, "failed").when(F.col("skipped") + F.col("failed") > 0, "completed_partial").otherwise("completed").alias("status"))


def batch_units(files: DataFrame, size: int = UNIT) -> DataFrame:
    """Work units of ``size`` files by id within a snapshot; a snapshot of any size is numbered by ranges."""
    numbered = number_rows(files.select("snapshot_id", "id"), [F.asc("id")], "k", ["snapshot_id"])
    units = numbered.groupBy("snapshot_id", F.floor((F.col("k") - 1) / size).alias("unit")).agg(F.count(F.lit(1)).alias("files"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    last = units.groupBy("snapshot_id").agg(F.max("unit").alias("last"))
    return units.join(last, "snapshot_id").select("snapshot_id", "unit", "files", "first_id", "last_id", F.when(F.col("unit") < F.col("last"), F.col("last_id")).alias("next_cursor"))


@query("sym16", "WITH u AS (SELECT snapshot_id, id, (row_number() OVER (PARTITION BY snapshot_id ORDER BY id) - 1) // 50 AS unit FROM files), g AS (SELECT snapshot_id, unit, count(*) AS files, min(id) AS first_id, max(id) AS last_id FROM u GROUP BY 1, 2) SELECT *, CASE WHEN unit < max(unit) OVER (PARTITION BY snapshot_id) THEN last_id END AS next_cursor FROM g")
def sym16_units(t):
    return batch_units(t("files"))


@query("sym17", f"SELECT snapshot_id, unit_index, status, retry_count, files_processed AS files, bytes_processed AS symbols FROM {JOBS} WHERE status <> 'completed'")
def sym17_jobs(t):
    return job_states(t("job_events")).where("status <> 'completed'").select("snapshot_id", "unit_index", "status", "retry_count", F.col("files_processed").alias("files"), F.col("bytes_processed").alias("symbols"))


def symbol_tree(nodes: DataFrame) -> DataFrame:
    """Root and depth of every node(node, parent); a missing or self parent makes a root.

    Pointer jumping: the distance known of each node doubles in every round, and
    rounds go on until every node is at its root, so chains may be of any length.
    Nodes on or below a circle of parents have no root: root and depth are null.
    """
    parents = nodes.select(F.col("node").alias("known")).distinct()
    real = nodes.join(parents, nodes.parent == F.col("known"), "left")
    up = F.when(F.col("known").isNotNull() & (F.col("known") != F.col("node")), F.col("known"))
    state = save(real.select("node", F.coalesce(up, F.col("node")).alias("at"), up.isNotNull().cast("long").alias("depth"), up.isNull().alias("settled")), "tree")
    left = -1
    while (now := state.where("not settled").count()) and now != left:
        left = now
        ahead = state.select(F.col("node").alias("at"), F.col("at").alias("further"), F.col("depth").alias("more"), F.col("settled").alias("done"))
        moved = state.where("not settled").join(ahead, "at").select("node", F.col("further").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("done").alias("settled"))
        before, state = state, save(state.where("settled").unionByName(moved), "tree")
        drop_saved(before)
    return state.select("node", F.when(F.col("settled"), F.col("at")).alias("root"), F.when(F.col("settled"), F.col("depth")).alias("depth"))


@query("sym18", "WITH RECURSIVE n AS (SELECT event_id AS node, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id - 1 END AS parent FROM events), tree AS (SELECT node, node AS root, 0::BIGINT AS depth FROM n WHERE parent IS NULL OR parent NOT IN (SELECT node FROM n) UNION ALL SELECT n.node, tree.root, tree.depth + 1 FROM n JOIN tree ON n.parent = tree.node) SELECT * FROM tree")
def sym18_tree(t):
    nodes = t("events").select(F.col("event_id").alias("node"), F.when(F.col("event_id") % 10 != 0, F.col("event_id") - 1).alias("parent"))
    return symbol_tree(nodes)


@query("sym19", "SELECT id, path FROM files f WHERE NOT EXISTS (SELECT 1 FROM extractions e WHERE e.file_id = f.id)")
def sym19_skip(t):
    return t("files").join(t("extractions").select(F.col("file_id").alias("id")), "id", "left_anti").select("id", "path")
