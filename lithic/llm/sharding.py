"""Assignment to shards by a hierarchical weighted hash tree.

A document descends from zone to region, rack and shard. At every node each
child draws -ln(u) / weight with u a hash of the document's id, the child's name
and the number of the attempt, and the least draw wins, so children are chosen
in proportion to their weights (a node weighs what its places weigh). A change
of weights below one node changes draws only on the way down to it: documents
outside the changed subtrees stay where they are.

The tree has places for more shards than there are. Zone 0 holds 16 places, four
regions of two racks of two; each further zone holds as many places as all zones
before it, in regions of the same shape. Where a draw ends at a place without a
shard, the document draws again. The weights of the tree never change with the
number of shards, so one more shard only takes the documents that drew its place
before the one they have: it takes rows only into itself, whatever the number.
A zone whose places are not all drawn out after ``ATTEMPTS`` attempts (a chance
of 2**-64 beyond zone 0) gives way to the zones before it, zone 0 to shard 0.
DataFrame operations alone.

Defined results: the shard depends on the id and the shard count, so rows with
one id, and all null ids, share a shard; a null text has size 1 and the CRC of
the empty text; slots number each shard's rows without gaps, in an order of
hashes, and equal rows (same id and text, which no place tells apart) take
neighbouring slots and are numbered by one task; extra columns are kept
whatever their names, and columns that this operator adds replace those of the same name; an empty table
gives an empty result. Fewer than one shard is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import free_prefix, table
from lithic.llm.running import running_total

#: shape of a region: racks, shards a rack; regions of zone 0
RACKS, SHARDS, REGIONS = 2, 2, 4
BASE = REGIONS * RACKS * SHARDS
ATTEMPTS = 64


def zone_tree(zone: int) -> list[tuple[int, int, int, float]]:
    """(region, rack, place, weight) of each place of a zone."""
    first = BASE << (zone - 1) if zone else 0
    return [(p // (RACKS * SHARDS), p // SHARDS, p, 1.0) for p in range(first, BASE << zone)]


def _uniform(key: Column, level: str, child: Column, attempt: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), child, attempt), 11) + 1) / F.lit(float(1 << 53))


def _draw(key: Column, children: Column, level: str, attempt: Column) -> Column:
    """The child with the least weighted draw."""
    return F.array_min(F.transform(children, lambda c: F.struct((-F.log(_uniform(key, level, c["id"], attempt)) / c["weight"]).alias("draw"), c["id"].alias("id"), c.alias("child"))))["child"]


def shard_of(key: Column, tree: list[tuple[int, int, int, float]], attempt: Column | None = None) -> Column:
    """The place that each key draws in a tree of (region, rack, place, weight)."""
    attempt = F.lit(0) if attempt is None else attempt

    def nodes(rows: list, depth: int) -> Column:
        children = []
        for name in sorted({r[depth] for r in rows}):
            below = [r for r in rows if r[depth] == name]
            fields = [F.lit(name).alias("id"), F.lit(float(sum(r[3] for r in below))).alias("weight")]
            children.append(F.struct(*fields, *([nodes(below, depth + 1).alias("below")] if depth < 2 else [])))
        return F.array(*children)

    chosen = _draw(key, nodes([r for r in tree if r[3] > 0], 0), "region", attempt)
    chosen = _draw(key, chosen["below"], "rack", attempt)
    return _draw(key, chosen["below"], "shard", attempt)["id"]


def placed(key: Column, shards: int) -> Column:
    """The shard of each key among ``shards`` shards."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    zone = 0
    while BASE << zone < shards:
        zone += 1
    return _settled(key, shards, zone)


def _settled(key: Column, shards: int, zone: int) -> Column:
    """The shard of keys that are confined to the zones up to ``zone``."""
    tree, open_, before = zone_tree(zone), F.lit(-1), F.lit(-2)

    def draw(attempt: Column) -> Column:
        place = shard_of(key, tree, attempt)
        own = F.when(place < shards, place).otherwise(open_) if BASE << zone > shards else place
        if not zone:
            return own
        zones = F.array(*(F.struct(F.lit(k).alias("id"), F.lit(1.0).alias("weight")) for k in (0, 1)))  # those before, this one
        return F.when(_draw(key, zones, f"zone {zone}", attempt)["id"] == 1, own).otherwise(before)

    if BASE << zone > shards:
        step = lambda found, attempt: F.when(found != open_, found).otherwise(draw(attempt))
        found = F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), open_, step)
    else:
        found = draw(F.lit(0))
    return F.when(found >= 0, found).otherwise(_settled(key, shards, zone - 1) if zone else F.lit(0))


def assign_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard (the shard if there were one more)."""
    added = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.drop(*added).withColumns(
        {
            "size": (F.octet_length(text) + 1).cast("long"),
            "text_crc32": F.crc32(text),
            "law": F.lit("key"),
            "shard": placed(F.col("doc_id"), shards).cast("int"),
            "grown_shard": placed(F.col("doc_id"), shards + 1).cast("int"),
        }
    )
    place = f"{free_prefix(rows)}place"
    rows = rows.withColumn(place, F.lpad(F.hex(F.xxhash64("doc_id", "text_crc32", F.lit("slot"))), 16, "0"))
    numbered = running_total(rows, ["shard"], place, [F.col(place)], F.lit(1), docs.count(), "slot")
    return numbered.withColumn("slot", (F.col("slot") - 1).cast("long")).drop(place)


def op6_shard_tree(spark, sf_dir: str) -> DataFrame:
    """All documents into 16 shards."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_shards(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
