"""Numbering of all rows in a total order, spread over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic.saved import save


def number_rows(rows: DataFrame, order: list[Column], out: str = "position", group: list[str] | None = None) -> DataFrame:
    """``rows`` with their 1-based place in ``order``, in all or within each value of the ``group`` columns.

    Rows are dealt out by ranges of group and order and written with the number
    of their range: ranges depend on a sample and on how partitions are put
    together, so they are fixed once and both readers see the same. Each range
    numbers its own rows and adds those of its group in the ranges before it, of
    which there is one row a group and range. So no group is held by one task.
    """
    keys = group or []
    ranged = save(rows.repartitionByRange(*keys, *order).withColumn("_nr_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(*keys, "_nr_range").agg(F.count(F.lit(1)).alias("_nr_n"))
    earlier = W.partitionBy(*keys).orderBy("_nr_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*(F.col(k).alias(f"_nr_group_{k}") for k in keys), F.col("_nr_range").alias("_nr_of"), F.coalesce(F.sum("_nr_n").over(earlier), F.lit(0)).alias("_nr_before"))
    own = F.row_number().over(W.partitionBy(*keys, "_nr_range").orderBy(*order))
    same = F.col("_nr_range") == F.col("_nr_of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_nr_group_{k}"))
    numbered = ranged.withColumn("_nr_own", own).join(offsets, same)
    return numbered.withColumn(out, F.col("_nr_before") + F.col("_nr_own")).select(*rows.columns, out)
