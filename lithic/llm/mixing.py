"""Mixing sources to target weights by weighted fair queueing.

Every document has a place in the shuffled queue of its source (a hash of its
id) and a virtual finish time: the source's tokens up to it, divided by the
source's weight. A source that runs dry starts again, up to ``repeats`` times.
All documents are put in order of their finish times by ranges, and the order
is cut where the running total of tokens reaches the budget. Within a source
that cut is one place in one round of its queue, so the decision is one row a
source; it goes back to the documents without moving a text.

DataFrame operations alone. Sources are numbered and levelled in one task, which
holds one row a source: millions of sources fit, more do not. Targets come from the same law in closed form: the
level L with sum(min(L * weight, repeats * size)) = budget.

Defined results: a null text has size 0 and is taken 0 times; the null source
is a source like others, the last one; rows with equal ids in one source share
a place and are taken alike; ties of finish time go by source and place; extra
columns are kept whatever their names, and columns that this operator adds
replace those of the same name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic.llm.common import free_prefix, save, table, word_count
from lithic.llm.running import running_total

#: finish times are cut into this many equal steps up to the level
STEPS = 1 << 31


def place_of(doc_id: F.Column) -> F.Column:
    """Place in the shuffled queue: hexadecimal digits that depend on the id alone."""
    return F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 16)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """source, number, source_size, weight, level, budget, target from sizes(source, source_size): one row a source."""
    everything = W.partitionBy()
    numbered = sizes.withColumn("number", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    numbered = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") - 1) % len(weights) + 1))
    numbered = numbered.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share)).withColumn("cap", repeats * F.col("source_size"))
    # sources in the order in which they fill up; the level if just those before are full; the first that fits is the greatest
    order = W.orderBy(F.col("cap") / F.col("weight"), "number")
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    numbered = numbered.withColumn("reach", (F.col("budget") - full) / open_weight)
    fits = F.when(F.col("reach") <= F.col("cap") / F.col("weight"), F.col("reach"))
    numbered = numbered.withColumn("level", F.max(fits).over(everything))
    target = F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double"))
    return numbered.select("source", "number", "source_size", "weight", "level", "budget", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, repeats: int = 3) -> DataFrame:
    """docs(doc_id, text, source, ...) with size, source_size, target, times and taken on every row.

    ``share`` of all words is handed out; ``times`` says how often the mix takes
    the document, ``taken`` how many words that is.
    """
    docs = docs.drop("size", "source_size", "target", "times", "taken")
    place, source, name, round_, last = (f"{free_prefix(docs)}{n}" for n in ("place", "source", "name", "round", "last"))
    sized = docs.withColumn("size", word_count("text")).withColumn(place, place_of(F.col("doc_id"))).withColumn(source, F.col("source").cast("string"))
    units = save(sized.groupBy(F.col(source).alias("source"), F.col(place).alias("_place")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "units")
    sources = save(source_targets(units.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats), "sources")
    n = units.count()

    queue = units.where("size > 0").join(sources, units.source.eqNullSafe(sources.source)).select("number", "_place", "size", "source_size", "weight", "level", "budget")
    queue = running_total(queue, ["number"], "_place", [F.col("_place")], F.col("size"), n, "end")
    rounds = queue.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    finish = (F.col("round") * F.col("source_size") + F.col("end")) / F.col("weight")
    begin = (F.col("round") * F.col("source_size") + F.col("end") - F.col("size")) / F.col("weight")
    # a document is served once its turn has come: what begins after the level never does
    served = rounds.withColumn("finish", finish).where(begin < F.col("level"))
    step = F.least(F.floor(F.col("finish") / F.col("level") * STEPS), F.lit(2 * STEPS - 1)).cast("long")
    served = served.select("number", "_place", "size", "round", "finish", "budget", F.lpad(F.hex(step), 8, "0").alias("step"))
    total = running_total(served, [], "step", [F.col("finish"), F.col("number"), F.col("_place"), F.col("round")], F.col("size"), n * repeats, "total")
    cut = total.where("total <= budget").groupBy("number").agg(F.max(F.struct("round", "_place")).alias("last"))

    decided = save(sources.join(cut, "number", "left").select(F.col("source").alias(name), "source_size", "target", F.col("last.round").alias(round_), F.col("last._place").alias(last)), "mix")
    found = sized.join(decided, F.col(source).eqNullSafe(F.col(name)))
    times = F.when(F.col(round_).isNull() | (F.col("size") == 0), 0).when(F.col(place) <= F.col(last), F.col(round_) + 1).otherwise(F.col(round_))
    found = found.withColumn("times", times.cast("int")).withColumn("taken", (F.col("times") * F.col("size")).cast("long"))
    return found.drop(place, source, name, round_, last)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, repeats: int = 3) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with all its columns."""
    packed = docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    taken = mix_sources(packed, weights, share, repeats).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Weights 1, 2, 3 in turn, all words, at most three times, over all documents."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 16) AS place
  FROM documents
), units AS (
  SELECT source, place, sum(size)::BIGINT AS size FROM sized GROUP BY source, place
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM units GROUP BY source
), weighted AS (
  SELECT *, 1 + (number - 1) % 3 AS weight, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS budget FROM sizes
), reached AS (
  SELECT *, (budget - coalesce((sum(cap) OVER (ORDER BY cap / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))
            / (sum(weight) OVER (ORDER BY cap / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS reach
  FROM weighted
), sources AS (
  SELECT *, max(CASE WHEN reach <= cap / weight THEN reach END) OVER () AS level FROM reached
), queue AS (
  SELECT s.*, u.place, u.size, (sum(u.size) OVER (PARTITION BY s.number ORDER BY u.place))::BIGINT AS fin
  FROM units u JOIN sources s ON u.source IS NOT DISTINCT FROM s.source WHERE u.size > 0
), served AS (
  SELECT q.*, r.round, (r.round * source_size + fin) / weight AS finish
  FROM queue q, (SELECT unnest([0, 1, 2]) AS round) r WHERE (r.round * source_size + fin - size) / weight < level
), totals AS (
  SELECT *, sum(size) OVER (ORDER BY finish, number, place, round ROWS UNBOUNDED PRECEDING) AS total FROM served
), cut AS (
  SELECT number, max({'round': round, 'place': place}) AS last FROM totals WHERE total <= budget GROUP BY number
)
SELECT d.doc_id, d.size, s.source_size, least(s.level * s.weight, s.cap::DOUBLE) AS target,
       (d.size * CASE WHEN c.number IS NULL THEN 0 WHEN d.place <= c.last.place THEN c.last.round + 1 ELSE c.last.round END)::BIGINT AS taken
FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN cut c USING (number)
"""
