"""A filter of bounded size in front of a join with many keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bits of the filter, 8 MB
BITS = 1 << 26


def _bits(wanted: DataFrame, place: Column) -> DataFrame:
    """The bits of ``wanted``, one row for each part of the filter that has any."""
    marks = wanted.select(place.alias("_at")).select(F.bitmap_bucket_number("_at").alias("_part"), F.bitmap_bit_position("_at").alias("_at"))
    return F.broadcast(marks.repartition("_part").groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_bits")))


def _place(keys: list[str], salt: int | None = None) -> Column:
    return F.pmod(F.xxhash64(*keys, *([] if salt is None else [F.lit(salt)])), F.lit(BITS))


def _is_set(place: Column) -> Column:
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def may_match(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``keys`` no row of ``wanted`` has, so that a join moves less.

    A bit stands for all keys with one hash: no row that matches is left out, and
    the exact join must follow. The keys have the same types on both sides.
    """
    place = _place(keys)
    return rows.join(_bits(wanted, place), (F.bitmap_bucket_number(place) == F.col("_part")) & _is_set(place), "left_semi")


def settled(rows: DataFrame, keys: list[str], wanted: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: true where a row of ``wanted`` has the same ``keys``, false where none has, null where only a join can tell.

    Keys alone are moved to find those that pass the filter of ``wanted`` and match
    nothing. They make a second filter, by another hash: what passes the first only
    matches, what passes both is null.
    """

    def flagged(to: DataFrame, of: DataFrame, place: Column, flag: str) -> DataFrame:
        found = to.join(_bits(of, place), F.bitmap_bucket_number(place) == F.col("_part"), "left")
        return found.withColumn(flag, F.coalesce(_is_set(place), F.lit(False))).drop("_part", "_bits")

    wrong = may_match(rows.select(*keys), keys, wanted).distinct().join(wanted.select(*keys), keys, "left_anti")
    both = flagged(flagged(rows, wanted, _place(keys), "_first"), wrong, _place(keys, 1), "_second")
    return both.withColumn(name, F.when(~F.col("_first"), False).when(~F.col("_second"), True)).drop("_first", "_second")
