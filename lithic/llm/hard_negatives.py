"""Hard negatives of anchors by Fagin's threshold algorithm.

Vectors become integers, so scores are exact. Rows are dealt out, and each task
sees its rows in blocks; a block has one list of its rows for each dimension, in
order of that component. An anchor goes down all lists at once, from the top
where its own component is positive and from the bottom where it is negative.
Every row met for the first time is scored in full. No row that has not been met
can score more than the threshold, the product of the anchor with the components
last met. The walk ends when the threshold falls strictly below what every
window of the anchor still needs: its k-th score so far, from this and earlier
blocks of the task, or its lower end while it has fewer than k.

One walk finds the positives (same label, no bounds), which set the windows; a
second walk finds the negatives inside them. Anchors are a stated query set:
they are broadcast in portions of bounded size, each of which meets all rows.
Each task returns at most k rows for a window.

Defined results: rows without label or vector or with a null or non-finite
component take no part; rows with a null id are never anchors, can be found, and
come after other ids in ties; equal rows are rows each, so one can be the
positive of another, and equal anchors each have their result; components that a
shorter vector lacks are zero; components and scores beyond a long are held at
its bounds; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic.llm.common import drop_saved, new_path, save, table

#: rows of a block; bytes of anchors that are broadcast at a time
BLOCK, PORTION = 8192, 8 << 20
#: integers up to here are exact in doubles
EXACT = 1 << 53
LONG = (-(1 << 63), (1 << 63) - 1)

FOUND = "anchor int, positive int, anchor_id long, positive_id long, positive_score long, found array<struct<id:long,score:long>>"


class Rows:
    """Rows of vectors(vec_id, label, q, n) as arrays; ``q`` is padded with zeros."""

    def __init__(self, rows: pa.Table) -> None:
        self.null = np.asarray(rows.column("vec_id").is_null(), dtype=bool)
        self.id = np.asarray(rows.column("vec_id").fill_null(0), dtype=np.int64)
        self.label = np.asarray(rows.column("label"), dtype=np.int64)
        self.n = np.asarray(rows.column("n"), dtype=np.int64)
        vectors = pa.concat_arrays(rows.column("q").chunks) if rows.num_rows else pa.array([], type=pa.list_(pa.int64()))
        sizes = np.asarray(vectors.value_lengths(), dtype=np.int64)
        flat = np.asarray(vectors.flatten(), dtype=np.int64)
        self.q = np.zeros((len(sizes), sizes.max(initial=0)), dtype=np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        self.q[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat


def _both(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices with as many columns, as doubles if all products are exact in them, else as Python's integers."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    most = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    kind = np.float64 if most(a) * most(b) * width < EXACT else object
    return a.astype(kind), b.astype(kind)


class Window:
    """The first k rows of one kind within bounds of score, so far. Ties go by id, nulls last."""

    def __init__(self, k: int, same: bool, low: int | float, high: int | float) -> None:
        self.k, self.same, self.low, self.high = k, same, low, high
        self.best: list[tuple] = []  # (-score, null, id)

    @property
    def needs(self) -> int | float:
        return -self.best[-1][0] if len(self.best) == self.k else self.low

    def offer(self, anchor: Anchor, rows: Rows, met: np.ndarray, scores: np.ndarray) -> None:
        fits = (scores >= max(self.needs, self.low)) & (scores <= self.high) & ((rows.label[met] == anchor.label) == self.same)
        at = np.flatnonzero(fits)
        if len(at) > 4 * self.k:  # all with at least the k-th score
            at = at[scores[at] >= np.sort(scores[at])[-self.k - 1]]  # one more, as the anchor itself may be among them
        new = []
        for i in at:
            copies = int(rows.n[met[i]]) - anchor.is_row(rows, met[i])
            new += [(-int(scores[i]), bool(rows.null[met[i]]), int(rows.id[met[i]]))] * min(copies, self.k)
        if new:
            self.best = heapq.nsmallest(self.k, self.best + new)


class Anchor:
    """One anchor, with windows that fill up over the blocks of a task."""

    def __init__(self, number: int, anchors: Rows, windows: list[Window]) -> None:
        self.number, self.id, self.label, self.q, self.windows = number, int(anchors.id[number]), int(anchors.label[number]), anchors.q[number], windows

    def is_row(self, rows: Rows, i: int) -> bool:
        """Is row i of a block the anchor's own? Rows are distinct, so there is one."""
        if rows.null[i] or rows.id[i] != self.id or rows.label[i] != self.label:
            return False
        width = max(len(self.q), rows.q.shape[1])
        return np.array_equal(np.pad(self.q, (0, width - len(self.q))), np.pad(rows.q[i], (0, width - rows.q.shape[1])))

    def needs(self) -> int | float:
        return min(w.needs for w in self.windows)


class Lists:
    """A block with its rows in order of each component."""

    def __init__(self, rows: Rows, q: np.ndarray) -> None:
        self.rows, self.q = rows, q
        self.order = np.argsort(q, axis=0, kind="stable")

    def walk(self, anchor: Anchor, a: np.ndarray) -> int:
        """Offer the block's rows to the anchor's windows until no other can matter; how many were scored."""
        n, up, down = len(self.q), np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        seen, depth, step, scored = np.zeros(n, dtype=bool), 0, 8, 0
        if not len(up) and not len(down):  # no list to go down: every score is 0
            depth, seen[:] = n, True
            self._offer(anchor, np.arange(n), a)
        while depth < n and scored < n:
            to = min(n, depth + step)
            met = np.zeros(n, dtype=bool)
            met[self.order[n - to : n - depth, up].ravel()] = True
            met[self.order[depth:to, down].ravel()] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            scored += len(new)
            self._offer(anchor, new, a)
            last = self.q[self.order[n - to, up], up] @ a[up] + self.q[self.order[to - 1, down], down] @ a[down]
            if last < anchor.needs():
                break
            depth, step = to, 2 * step
        return scored

    def _offer(self, anchor: Anchor, new: np.ndarray, a: np.ndarray) -> None:
        if len(new):
            scores = self.q[new] @ a
            for window in anchor.windows:
                window.offer(anchor, self.rows, new, scores)


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[Rows]:
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, block):
            held.append(batch.slice(at, block))
            n += held[-1].num_rows
            if n >= block:
                yield Rows(pa.Table.from_batches(held))
                held, n = [], 0
    if n:
        yield Rows(pa.Table.from_batches(held))


def _long(value: int) -> int:
    return min(max(value, LONG[0]), LONG[1])


def _search(portion, block: int):
    """The windows of all anchors of a portion over the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, windows, about = portion.value
        anchors = Rows(anchors)
        walkers = [Anchor(i, anchors, [Window(*w) for w in windows[i]]) for i in range(len(anchors.id))]
        for rows in _blocks(batches, block):
            q, a = _both(rows.q, anchors.q)
            lists = Lists(rows, q)
            for walker in walkers:
                if walker.windows:
                    lists.walk(walker, a[walker.number])
        out = []
        for walker in walkers:
            for k, window in enumerate(walker.windows):
                if window.best:
                    number, positive_id, score = about[walker.number][k] if about else (k, None, None)
                    out.append((walker.number, number, walker.id, positive_id, score, [{"id": None if null else i, "score": _long(-s)} for s, null, i in window.best]))
        if out:
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 3, pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())]))]
            yield pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["anchor", "positive", "anchor_id", "positive_id", "positive_score", "found"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first k of what all tasks found for each window, numbered; a task sends at most k."""
    rows = found.select("*", F.explode("found").alias("hit")).select("anchor", "positive", "anchor_id", "positive_id", "positive_score", "hit.*")
    place = F.row_number().over(W.partitionBy("anchor", "positive").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def vectors_of(embeddings: DataFrame, relabel: int, classes: int, scale: int) -> DataFrame:
    """Distinct rows (vec_id, label, q, n) that take part, as integers; saved."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("embedding"))
    rows = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    label = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    q = F.transform("embedding", lambda x: F.floor(x * scale).cast("long"))
    return save(rows.select("vec_id", label.alias("label"), q.alias("q")).groupBy("vec_id", "label", "q").agg(F.count(F.lit(1)).alias("n")), "vectors")


def hard_negatives(
    embeddings: DataFrame, anchors_of: int = 50, positives: int = 5, negatives: int = 3, bounds: tuple[int, int] = (50, 95),
    relabel: int = 7, classes: int = 10, scale: int = 256, block: int = BLOCK, portion: int = PORTION,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from embeddings(vec_id, embedding, label).

    Anchors are the rows whose id is divisible by ``anchors_of``; negatives score
    from ``bounds[0]`` to ``bounds[1]`` percent of their positive's score.
    """
    spark = embeddings.sparkSession
    vectors = vectors_of(embeddings, relabel, classes, scale)
    anchors = vectors.where(F.col("vec_id") % anchors_of == 0)
    size = anchors.agg(F.sum(F.size("q") * 8 + 64)).first()[0] or 0
    n_portions = max(1, -(-size // portion))
    path = new_path(spark, "negatives")
    for k in range(n_portions):
        held = anchors.where(F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(n_portions)) == k).toArrow()
        everything = [[(positives, True, float("-inf"), float("inf"))]] * held.num_rows
        shared = spark.sparkContext.broadcast((held, everything, None))
        found = _best(vectors.mapInArrow(_search(shared, block), FOUND), positives).select("anchor", "rank", "id", "score").orderBy("anchor", "rank").toArrow().to_pylist()
        shared.destroy()
        windows, about = ([[] for _ in range(held.num_rows)] for _ in range(2))
        for hit in found:
            low, high = -(-hit["score"] * bounds[0] // 100), hit["score"] * bounds[1] // 100
            if low <= high:
                windows[hit["anchor"]].append((negatives, False, low, high))
                about[hit["anchor"]].append((hit["rank"], hit["id"], hit["score"]))
        shared = spark.sparkContext.broadcast((held, windows, about))
        copies = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(held.num_rows), type=pa.int32()), "n": held.column("n")}))
        best = _best(vectors.mapInArrow(_search(shared, block), FOUND), negatives).join(F.broadcast(copies), "anchor")
        best = best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
        best.drop("copy").write.mode("append").parquet(path)
        shared.destroy()
    drop_saved(vectors)
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(path)


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Anchors of all embeddings against all of them."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5
), m AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 3
"""
