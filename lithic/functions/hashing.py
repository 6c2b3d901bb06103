"""A deterministic pseudo-random number for a short text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: 32-bit FNV-1a
OFFSET, PRIME, MASK = 2166136261, 16777619, 4294967295


def unit_hash(text: Column) -> Column:
    """32-bit FNV-1a of an ASCII text, scaled to [0, 1]."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(PRIME)).bitwiseAND(F.lit(MASK))
    return F.aggregate(F.split(text, ""), F.lit(OFFSET).cast("long"), step) / F.lit(float(MASK))
