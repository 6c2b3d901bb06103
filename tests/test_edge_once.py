"""An edge store makes its edges once, though both sides and the ranges read them."""

from pyspark.sql import functions as F

from lithic.operators.edge_store import read_edges, write_edges


def test_edges_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(k):
        made.add(1)
        return f"{k:04}"

    rows = spark.range(200).select(F.lit(1).cast("long").alias("snapshot_id"), F.lit("CALLS").alias("type"), F.lit("a").alias("source"), F.lit("b").alias("target"), key("id").alias("key"), F.lit("UNKNOWN").alias("state"), F.lit(None).cast("array<string>").alias("candidates"))
    write_edges(rows, str(tmp_path / "store"), 4)
    assert made.value == 200
    assert read_edges(spark, str(tmp_path / "store")).count() == 400
