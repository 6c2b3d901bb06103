"""Domain tables derived from the driver's tables, for queries and their SQL twins.

Each view is one SQL text for both engines; the few functions that differ are
methods of a dialect. In the Spark text other tables stand in braces.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from lithic.saved import save

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def pick(expr: str, values: list) -> str:
    """A CASE that picks by ``expr`` modulo the number of values; None is NULL."""
    text = lambda x: "CAST(NULL AS VARCHAR(40))" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return f"CASE ({expr}) % {len(values)} " + " ".join(f"WHEN {k} THEN {text(x)}" for k, x in enumerate(values)) + " END"


class Duck:
    text = "VARCHAR"
    no_texts = "[]::VARCHAR[]"

    def ref(self, name: str) -> str:
        return name

    def array(self, *xs: str) -> str:
        return f"list_value({', '.join(xs)})"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def octets(self, x: str) -> str:
        return f"CAST(strlen({x}) AS BIGINT)"

    def day(self, x: str) -> str:
        return f"strftime({x}, '%Y-%m-%d')"

    def lines(self, x: str) -> str:
        """(pos, line) of a text's lines, from 0."""
        return f"(SELECT unnest(string_split({x}, chr(10))) AS line, generate_subscripts(string_split({x}, chr(10)), 1) - 1 AS pos)"

    def word(self, x: str, last: bool = False) -> str:
        return f"regexp_extract({x}, '{'[A-Za-z]+' if not last else '([A-Za-z]+)[^A-Za-z]*$'}'{', 1' if last else ''})"

    def millis(self, x: str) -> str:
        return f"(epoch_us({x}) // 1000)"


class Spark(Duck):
    text = "STRING"
    no_texts = "cast(array() as array<string>)"

    def ref(self, name: str) -> str:
        return "{" + name + "}"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def octets(self, x: str) -> str:
        return f"CAST(octet_length({x}) AS BIGINT)"

    def day(self, x: str) -> str:
        return f"date_format({x}, 'yyyy-MM-dd')"

    def lines(self, x: str) -> str:
        return f"posexplode(split({x}, '\\n'))"

    def word(self, x: str, last: bool = False) -> str:
        # from its end, as a pattern tied to the end is tried anew at every letter of a line
        return f"reverse(regexp_extract(reverse({x}), '[A-Za-z]+', 0))" if last else f"regexp_extract({x}, '[A-Za-z]+', 0)"

    def millis(self, x: str) -> str:
        return f"unix_millis(cast({x} as timestamp))"


LANGUAGES = ["TypeScript", "Java", "Python", "Go", None, "Rust", "Kotlin"]
TOPICS = ["rag", "spring-boot", "oauth", "docker", "android", "cli", "react", "postgres", "misc", "kafka"]
EXTENSIONS = [".ts", ".tsx", ".java", ".js", ".md", ".JSON", "", ".mjs", ".d.ts", ".py"]
STATUSES = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'in_progress' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"
SOURCE = "CAST(substr(source, 4) AS BIGINT)"


def repos(d: Duck) -> str:
    return f"""
SELECT p_partkey AS id, replace(p_name, ' ', '-') AS name,
  concat('owner', p_partkey % 40, '/', replace(p_name, ' ', '-'), '-', p_partkey) AS full_name,
  concat('https://forge.example/owner', p_partkey % 40, '/', replace(p_name, ' ', '-'), '-', p_partkey) AS html_url,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE concat(p_name, ' ', lower(p_type)) END AS description,
  {pick('p_partkey', LANGUAGES)} AS language,
  CASE WHEN p_partkey % 9 = 0 THEN {d.no_texts} ELSE {d.array(pick('p_size', TOPICS), pick('p_partkey + 3', TOPICS))} END AS topics,
  coalesce(l.stars, 0) AS stars, coalesce(l.forks, 0) AS forks, l.pushed_at,
  p_partkey % 11 = 0 AS archived, p_partkey % 5 = 0 AS fork, concat('owner', p_partkey % 40) AS source_login
FROM {d.ref('part')} LEFT JOIN (
  SELECT l_partkey, count(*) AS stars, count(DISTINCT l_suppkey) AS forks, {d.day('max(l_shipdate)')} AS pushed_at FROM {d.ref('lineitem')} GROUP BY l_partkey
) l ON l_partkey = p_partkey"""


def repo_sources(d: Duck) -> str:
    return f"""
SELECT *, 1 AS source_ordinal, id AS ordinal FROM {d.ref('repos')}
UNION ALL
SELECT id, name, full_name, html_url, description, language, topics, stars + 1 AS stars, forks, pushed_at, archived, fork, source_login, 2 AS source_ordinal, 1000000000 + id AS ordinal
FROM {d.ref('repos')} WHERE id % 13 = 0"""


def source_outcomes(d: Duck) -> str:
    return f"""
SELECT concat('owner', s_suppkey % 40) AS login, s_suppkey AS ordinal, s_suppkey % 6 = 0 AS failed,
  CASE WHEN s_suppkey % 6 = 0 THEN {pick('s_suppkey', ['SOURCE_NOT_FOUND', 'RATE_LIMITED', 'NETWORK'])} END AS code
FROM {d.ref('supplier')}"""


def source_inputs(d: Duck) -> str:
    return f"""
SELECT page_id, page_id % 50 AS batch, page_id AS ordinal,
  CASE WHEN page_id % 29 = 0 THEN '  ' WHEN page_id % 10 = 0 THEN concat('@U', page_id % 7)
    ELSE concat(CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END, CASE WHEN page_id % 4 = 0 THEN '.git' ELSE '' END, CASE WHEN page_id % 6 = 0 THEN '//' ELSE '' END) END AS raw
FROM {d.ref('pages')}"""


def files(d: Duck) -> str:
    return f"""
SELECT doc_id + 1 AS id, {SOURCE} + 1 AS snapshot_id, concat(lang, '/m', doc_id % 6, '/f', doc_id, {pick('doc_id', EXTENSIONS)}) AS path,
  {d.octets('text')} AS size_bytes, {d.sha('text')} AS content_hash, doc_id, text
FROM {d.ref('documents')}"""


def files_head(d: Duck) -> str:
    return f"""
SELECT id, snapshot_id, path, size_bytes, CASE WHEN doc_id % 10 = 3 THEN {d.sha("concat(text, '#head')")} ELSE content_hash END AS content_hash FROM {d.ref('files')} WHERE doc_id % 17 <> 0
UNION ALL
SELECT id + 1000000000 AS id, snapshot_id, concat(path, '.new') AS path, size_bytes, content_hash FROM {d.ref('files')} WHERE doc_id % 19 = 0"""


def snapshots(d: Duck) -> str:
    return f"""
SELECT event_id AS id, user_id % 25 + 1 AS repository_id, substr({d.sha(f"CAST(user_id % 60 AS {d.text})")}, 1, 40) AS commit_sha,
  CAST(row_number() OVER (PARTITION BY user_id % 25, user_id % 60 ORDER BY event_id) AS BIGINT) AS attempt_number, {STATUSES} AS status,
  CASE WHEN event_id % 3 = 0 THEN 'bulk_archive' ELSE 'incremental_api' END AS acquisition_mode,
  {d.millis('ts')} AS created_at, CASE WHEN event_type = 'purchase' THEN {d.millis('ts')} + 1000 END AS completed_at
FROM {d.ref('events')}"""


def job_events(d: Duck) -> str:
    return f"""
SELECT event_id, user_id + 1 AS snapshot_id, event_id % 5 AS unit_index, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failure' ELSE 'pending' END AS event,
  CAST(floor(value) AS BIGINT) AS cursor_at, CASE WHEN event_type = 'error' THEN concat('reason ', event_id % 4) END AS reason,
  event_id % 7 AS files_processed, event_id % 1000 AS bytes_processed, {d.millis('ts')} AS at_ms
FROM {d.ref('events')}"""


def _text_lines(d: Duck, source: str) -> str:
    return f"""
SELECT id AS file_id, snapshot_id, path, doc_id, CAST(pos AS BIGINT) AS start_line, CAST(length(line) AS BIGINT) AS line_length,
  lower({d.word('line')}) AS name, lower({d.word('line', True)}) AS callee,
  CASE WHEN pos = 0 THEN 'class' WHEN pos % 3 = 0 THEN 'function' ELSE 'method' END AS kind
FROM {source} WHERE length(trim(line)) > 0"""


def text_lines(d: Duck) -> str:
    if isinstance(d, Spark):
        return _text_lines(d, "(SELECT id, snapshot_id, path, doc_id, posexplode(split(text, '\\\\n')) AS (pos, line) FROM {files})")
    return _text_lines(d, "(SELECT id, snapshot_id, path, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM files)")


def extractions(d: Duck) -> str:
    language = f"CASE {pick('doc_id', ['typescript', 'tsx', 'java', 'javascript', None, None, None, 'javascript', 'typescript', None])} WHEN '' THEN NULL ELSE {pick('doc_id', ['typescript', 'tsx', 'java', 'javascript', None, None, None, 'javascript', 'typescript', None])} END"
    return f"""
SELECT id AS file_id, snapshot_id, path, size_bytes, language,
  CASE WHEN language IS NULL OR size_bytes > 20000 THEN 'skipped_unsupported' WHEN doc_id % 23 = 0 THEN 'failed' ELSE 'extracted' END AS status,
  CASE WHEN language IS NOT NULL AND size_bytes > 20000 THEN 'exceeds size ceiling'
    WHEN language IS NOT NULL AND doc_id % 23 = 0 THEN {pick('doc_id', ['parse produced Syntax Errors', 'object could not decode', 'not valid UTF-8', 'worker crashed'])} END AS failure_reason,
  doc_id
FROM (SELECT *, {language} AS language FROM {d.ref('files')} WHERE doc_id % 31 <> 0) f"""


def directories(d: Duck) -> str:
    return f"""
SELECT DISTINCT snapshot_id, path, parent_path FROM (
  SELECT snapshot_id, '' AS path, CAST(NULL AS {d.text}) AS parent_path FROM {d.ref('files')}
  UNION ALL SELECT snapshot_id, split_part(path, '/', 1), '' FROM {d.ref('files')}
  UNION ALL SELECT snapshot_id, concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)), split_part(path, '/', 1) FROM {d.ref('files')}
) x"""


def spans(d: Duck) -> str:
    return f"""
SELECT event_id, user_id, event_id % 1000 AS start_at, event_id % 1000 + CAST(floor(value) AS BIGINT) % 90 AS end_at FROM {d.ref('events')}"""


def vectors(d: Duck) -> str:
    return f"SELECT vec_id, label, embedding FROM {d.ref('embeddings')}"


VIEWS = {f.__name__: f for f in (repos, repo_sources, source_outcomes, source_inputs, files, files_head, snapshots, job_events, text_lines, extractions, directories, spans, vectors)}


def with_views(sql: str) -> str:
    """DuckDB text of a query with the views that it names in front."""
    duck, needed = Duck(), {}

    def visit(text: str) -> None:
        for name, make in VIEWS.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|from|join)\s+{name}\b|,\s*{name}\s+\w\b", text):
                body = make(duck)
                needed[name] = None
                visit(body)
                del needed[name]
                needed[name] = body

    visit(sql)
    head = ",\n".join(f"{name} AS ({body})" for name, body in needed.items())
    if not head:
        return sql
    rest = sql.lstrip()
    if rest[:5].upper() == "WITH ":
        recursive = rest[5:].lstrip().upper().startswith("RECURSIVE")
        rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", rest, flags=re.IGNORECASE)
        return f"WITH {'RECURSIVE ' if recursive else ''}{head},\n{rest}"
    return f"WITH {head}\n{rest}"


class Tables:
    """Driver tables and views of one data set, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    @cached_property
    def _dialect(self) -> Spark:
        return Spark()

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._made[name] = self.sql(VIEWS[name](self._dialect))
        return self._made[name]

    def saved(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A derived table that is written once and read by all that ask for it."""
        if f"saved {name}" not in self._made:
            self._made[f"saved {name}"] = save(make(), name)
        return self._made[f"saved {name}"]

    def sql(self, text: str) -> DataFrame:
        names = set(re.findall(r"\{(\w+)\}", text))
        return self.spark.sql(text, **{n: self(n) for n in names})
