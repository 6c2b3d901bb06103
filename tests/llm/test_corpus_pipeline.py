"""The corpus pipeline keeps its columns and lets each stage's decisions take effect."""

from pyspark.sql import functions as F

import corpus_pipeline
from lithic.llm import decontaminate, mixing, near_dedup, quality
from lithic.llm.common import save, table


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, save(stage(spark, docs, small), "stage")
        assert docs.columns == columns
        seen[name] = (before, docs)
    assert all(after.count() for _, after in seen.values())
    before, after = seen["quality rules"]
    verdicts = {r.doc_id: r.kept for r in quality.quality_rules(before, table(spark, small, "labels")).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.select("doc_id").collect() if verdicts[r.doc_id])
    before, after = seen["near-duplicates"]
    kept = {r.doc_id for r in near_dedup.near_duplicates(before).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept and after.count() == len(kept)
    before, clean = seen["decontamination"]
    hit = {r.doc_id for r in decontaminate.decontaminate(before, table(spark, small, "benchmark")).where("contaminated").collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted({r.doc_id for r in before.select("doc_id").collect()} - hit)
    assert decontaminate.decontaminate(clean, table(spark, small, "benchmark")).where("contaminated").count() == 0
    before, mixed = seen["mixing"]
    times = {r.doc_id: r.times for r in mixing.mix_sources(before).where("times > 0").collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == times
    assert mixed.groupBy("doc_id").count().where("count > 3").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, mixed, small)
    assert last.count() == mixed.count() and set(columns) <= set(last.columns)
    sizes = {r.shard: (r.n, r.most) for r in last.groupBy("shard").agg({"slot": "max", "doc_id": "count"}).toDF("shard", "most", "n").collect()}
    assert all(most == n - 1 for n, most in sizes.values())


def test_no_rows(spark, small, tmp_path):
    """Every stage takes a table without rows."""
    docs = table(spark, small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, small), "stage")
        assert docs.count() == 0


#: names that the operators' modules use for columns of their own, and none that they add to results
WORKING = "_row _place _source _name _round _last _at _before _above _upper _sum _own _id __at __row row found key block node part cluster group start before first last m k n number level budget weight cap end total step times_ digest path".split()


def test_extra_columns_of_any_name_stay_as_they_are(spark, small):
    docs = table(spark, small, "documents").limit(150)
    docs = save(docs.select("*", *(F.concat(F.lit(f"{name}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(name) for name in WORKING)), "wide")
    for name, stage in corpus_pipeline.STAGES:
        docs = save(stage(spark, docs, small), "stage")
        rows = docs.select("doc_id", *WORKING).collect()
        assert rows and all(r[w] == f"{w}:{r.doc_id}" for r in rows for w in WORKING), name
    mixed = mixing.mix_sources(table(spark, small, "documents").select("*", *(F.col("doc_id").alias(w) for w in WORKING)))
    assert all(r[w] == r.doc_id for r in mixed.collect() for w in WORKING)
