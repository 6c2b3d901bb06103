"""Shared pieces of the operators: tables, saved intermediate results, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lithic.saved import drop_saved, new_path, save, shared_dir

__all__ = ["drop_saved", "free_prefix", "modest_batches", "new_path", "packed", "save", "shared_dir", "table", "text_bytes", "word_count"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts; sizes sketches and bucket counts."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def word_count(text: Column | str, pattern: str = r"[^\x20\x09-\x0D]+") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def free_prefix(docs: DataFrame) -> str:
    """What no column of ``docs`` begins with, in any case: working columns named so clash with none."""
    prefix = "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def modest_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` rows from here on: texts are long, and a task holds a few batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def packed(docs: DataFrame, carry: list[str]) -> tuple[DataFrame, int | None]:
    """docs as (row, text), or as (row) alone with the field number of a string text inside ``row``."""
    row = F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")
    if "text" in carry and docs.schema["text"].dataType == StringType():
        return docs.select(row), carry.index("text")
    return docs.select(row, F.col("text").cast("string").alias("text")), None
