"""Operators do the whole job where a bound or a cut once stood in the way."""

import random

from pyspark.sql import functions as F

from lithic.llm import secrets


def test_rare_finds_train_the_model(spark):
    """One document with finds among more than any sample would hold."""
    rnd = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    find = "\n".join("password: " + "".join(rnd.choice(letters) for _ in range(24)) for _ in range(60))
    plain = spark.range(400_000).select(F.col("id").alias("doc_id"), F.lit("ordinary identifiers continue with some_function_name").alias("text"))
    few = spark.createDataFrame([(-1, find), (-2, "key 9fQ2xLr8Tz0bVw7KpY3mNc")], "doc_id long, text string")
    found = {r.doc_id: r for r in secrets.find_secrets(plain.union(few)).where("doc_id < 0").collect()}
    assert found[-1].n_assign == 60 and "markov:4:26" in found[-2].spans
