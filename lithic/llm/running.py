"""Running totals in a global order without gathering a group in one task.

The order key is a string of hexadecimal digits. Sums by its leading digits
give the offset of every stretch, level by level with at most 256 stretches
below one, and only the last stretch is summed row by row. DataFrame
operations alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic.llm.common import drop_saved, free_prefix, save

#: rows of a last stretch, on average, at most
STRETCH = 1024


def running_total(rows: DataFrame, group: list[str], digits_of: str, order: list[Column], value: Column, n: int, out: str) -> DataFrame:
    """``rows`` with the running sum of ``value`` (itself included) in the order ``order`` within ``group``.

    ``digits_of`` names a column of evenly spread hexadecimal digits that agrees
    with ``order``; ``n`` is about the number of rows; group columns hold no nulls.
    """
    digits = 2
    while 16**digits * STRETCH < n:
        digits += 1
    levels = [*range(2, digits, 2), digits]
    prefix = free_prefix(rows)
    at, before_ = f"{prefix}at", f"{prefix}before"
    rows = rows.withColumn(at, F.substring(digits_of, 1, digits))
    sums = save(rows.groupBy(*group, F.col(at).alias("_at")).agg(F.sum(value).alias("_sum")), "sums")
    offsets = None
    for above, level in zip([0, *levels], levels, strict=False):
        part = sums.groupBy(*group, F.substring("_at", 1, level).alias("_at")).agg(F.sum("_sum").alias("_sum"))
        part = part.withColumn("_above", F.substring("_at", 1, above))
        before = F.coalesce(F.sum("_sum").over(W.partitionBy(*group, "_above").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        part = part.select(*group, "_at", "_above", before.alias("_before"))
        if offsets is not None:
            upper = offsets.select(*group, F.col("_at").alias("_above"), F.col("_before").alias("_upper"))
            part = part.join(upper, [*group, "_above"]).withColumn("_before", F.col("_before") + F.col("_upper"))
        offsets = part.select(*group, "_at", "_before")
    offsets = save(offsets.select(*group, F.col("_at").alias(at), F.col("_before").alias(before_)), "offsets")
    drop_saved(sums)
    inside = F.sum(value).over(W.partitionBy(*group, at).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.join(offsets, [*group, at]).withColumn(out, F.col(before_) + inside).drop(at, before_)
