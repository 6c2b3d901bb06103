"""Exact order statistics of groups of any size.

A rank is found by narrowing an interval of values. Each pass takes a summary of
bounded size of the values in the interval, which proposes two values around the
rank; exact counts below and up to them say on which side the rank is, or that
it is one of the two. A pass leaves about a hundredth of the values, so a handful
narrows any group to few, which are put in order. No task and no buffer holds the
values of a group; ties may be as long as the group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic.saved import drop_saved, save

#: values that are put in order at once; steps of a summary, and its accuracy
FEW, STEPS, ACCURACY = 4096, 256, 4096


def _mine(keys: list[str]) -> Column:
    """Keys equal, nulls too, to those named with a line before them."""
    return reduce(Column.__and__, (F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys))


def _inside(value: Column) -> Column:
    return (F.col("low").isNull() | (value > F.col("low"))) & (F.col("high").isNull() | (value < F.col("high")))


def exact_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], few: int = FEW) -> DataFrame:
    """The values at ``ranks`` (1-based, expressions of the column n) of each group of rows(keys, value), and n.

    Null values do not count; a group without values has n = 0 and nulls.
    """
    own = rows.select(*(F.col(k) for k in keys), F.col(value).alias("_v"))
    counts = save(own.groupBy(*keys).agg(F.count("_v").alias("n")), "group-sizes")
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("which"), at.cast("long").alias("rank")) for name, at in ranks.items())))
    null = F.lit(None).cast(own.schema["_v"].dataType)
    # a target's rank among the values between low and high, both left out, of which there are n
    targets = counts.where("n > 0").select(*keys, wanted.alias("t"), "n").select(*keys, "t.which", "t.rank", "n", null.alias("low"), null.alias("high"), null.alias("found"))
    targets = save(targets, "targets")
    while not (large := targets.where((F.col("n") > few) & F.col("found").isNull())).isEmpty():
        narrowed = save(_narrowed(own, keys, large), "targets")
        rest = targets.where((F.col("n") <= few) | F.col("found").isNotNull())
        merged = save(rest.unionByName(narrowed), "targets")
        drop_saved(targets, narrowed)
        targets = merged
    # the values left of each open target, few of them, in order
    open_ = targets.where("found is null").drop("found", "n")
    left = open_.withColumnsRenamed({k: f"_{k}" for k in keys}).join(own, _mine(keys) & _inside(F.col("_v")) & F.col("_v").isNotNull())
    place = F.row_number().over(W.partitionBy(*keys, "which").orderBy("_v"))
    settled = left.withColumn("_at", place).where(F.col("_at") == F.col("rank")).select(*keys, "which", F.col("_v").alias("found"))
    settled = settled.unionByName(targets.where("found is not null").select(*keys, "which", "found"))
    wide = settled.groupBy(*keys).agg(*(F.max(F.when(F.col("which") == name, F.col("found"))).alias(name) for name in ranks))
    wide = wide.withColumnsRenamed({k: f"_{k}" for k in keys})
    return counts.join(wide, _mine(keys), "left").select(*keys, "n", *ranks)


def _narrowed(own: DataFrame, keys: list[str], large: DataFrame) -> DataFrame:
    """Targets with the interval that their rank lies in, and its number of values, or with the value found."""
    renamed = large.withColumnsRenamed({k: f"_{k}" for k in keys})
    mine = _mine(keys)
    intervals = renamed.select(*(f"_{k}" for k in keys), "low", "high").distinct()
    steps = F.array(*(F.lit(k / STEPS) for k in range(STEPS + 1)))
    summary = own.join(intervals, mine & _inside(F.col("_v"))).groupBy(*(f"_{k}" for k in keys), "low", "high").agg(F.percentile_approx("_v", steps, ACCURACY).alias("steps"))
    ends = [*(f"_{k}" for k in keys), "low", "high"]
    summary = summary.withColumnsRenamed({c: f"s_{c}" for c in ends})
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"s_{c}")) for c in ends))
    at = F.floor(F.col("rank") / F.col("n") * STEPS).cast("int")
    step = lambda k: F.get("steps", F.least(F.greatest(k, F.lit(0)), F.lit(STEPS)))
    proposed = renamed.join(summary, same).select(*ends, "which", "rank", "n", step(at - 1).alias("a"), step(at + 2).alias("b"))
    v, a, b = F.col("_v"), F.col("a"), F.col("b")
    about = [*(f"_{k}" for k in keys), "which", "rank", "n", "low", "high", "a", "b"]
    counted = own.join(proposed, mine & _inside(v)).groupBy(*about).agg(F.count_if(v < a).alias("below_a"), F.count_if(v <= a).alias("to_a"), F.count_if(v < b).alias("below_b"), F.count_if(v <= b).alias("to_b"))
    rank = F.col("rank")
    side = lambda under, first, middle, second, over: F.when(rank <= F.col("below_a"), under).when(rank <= F.col("to_a"), first).when(rank <= F.col("below_b"), middle).when(rank <= F.col("to_b"), second).otherwise(over)
    null = F.lit(None)
    return counted.select(
        *(F.col(f"_{k}").alias(k) for k in keys), "which",
        side(rank, null, rank - F.col("to_a"), null, rank - F.col("to_b")).cast("long").alias("rank"),
        side(F.col("below_a"), null, F.col("below_b") - F.col("to_a"), null, F.col("n") - F.col("to_b")).cast("long").alias("n"),
        side(F.col("low"), null, a, null, b).alias("low"), side(a, null, b, null, F.col("high")).alias("high"), side(null, a, null, b, null).alias("found"),
    )


def middle_and_p95(rows: DataFrame, keys: list[str], value: str, few: int = FEW) -> DataFrame:
    """For each group: n, mid (the mean of the middle two values) and p95 (nearest rank)."""
    n = F.col("n")
    found = exact_ranks(rows, keys, value, {"_low_mid": F.floor((n + 1) / 2), "_high_mid": F.floor(n / 2) + 1, "p95": F.greatest(F.ceil(F.lit(0.95) * n), F.lit(1))}, few)
    return found.select(*keys, "n", ((F.col("_low_mid") + F.col("_high_mid")) / 2).alias("mid"), "p95")
