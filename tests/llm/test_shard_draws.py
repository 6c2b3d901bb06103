"""The shard tree against plain Python draws, and its law for any number of shards."""

import collections
import math
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from lithic.llm import sharding

IDS = 6000


def plain_draw(key, level, children, attempt):
    """The child (id, weight, ...) with the least -ln(u) / weight."""

    def draw(child):
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        h = xxhash.xxh64_intdigest(level.encode(), h)
        h = xxhash.xxh64_intdigest(struct.pack("<i", child[0]), h)
        h = xxhash.xxh64_intdigest(struct.pack("<i", attempt), h)
        return -math.log(((h >> 11) + 1) / float(1 << 53)) / child[1], child[0]

    return min(children, key=draw)


def plain_place(key, zone, attempt):
    first = 16 << (zone - 1) if zone else 0
    places = range(first, 16 << zone)
    for level, size in (("region", 4), ("rack", 2), ("shard", 1)):
        groups = collections.Counter(p // size for p in places)
        own = plain_draw(key, level, sorted(groups.items()), attempt)[0]
        places = [p for p in places if p // size == own]
    return places[0]


def plain_shard(key, shards):
    zone = 0
    while 16 << zone < shards:
        zone += 1
    while True:
        for attempt in range(64):
            if zone and plain_draw(key, f"zone {zone}", [(0, 1.0), (1, 1.0)], attempt)[0] == 0:
                break
            place = plain_place(key, zone, attempt)
            if place < shards:
                return place
        if not zone:
            return 0
        zone -= 1


@pytest.fixture(scope="module")
def shards(spark):
    """The shard of every id for 1 to 41 shards."""
    ids = spark.range(IDS).select(F.col("id").alias("doc_id")).repartition(8)
    found = {}
    for few in range(1, 42, 8):
        own = list(range(few, min(few + 8, 42)))
        for r in ids.select("doc_id", *(sharding.placed(F.col("doc_id"), n).alias(f"s{n}") for n in own)).collect():
            found.setdefault(r.doc_id, {}).update({n: r[f"s{n}"] for n in own})
    return found


@pytest.mark.parametrize("count", [1, 2, 5, 15, 16, 17, 24, 33])
def test_same_as_plain_draws(shards, count):
    assert all(shards[k][count] == plain_shard(k, count) for k in range(0, IDS, 20))


def test_one_more_shard_only_gains(shards):
    for count in range(1, 41):
        assert all(own[count + 1] in (own[count], count) for own in shards.values())
        moved = sum(own[count + 1] != own[count] for own in shards.values())
        assert abs(moved - IDS / (count + 1)) < 5 * math.sqrt(IDS / (count + 1))


def test_shards_are_about_equal(shards):
    for count in (3, 10, 16, 29, 40):
        sizes = collections.Counter(own[count] for own in shards.values())
        assert set(sizes) == set(range(count)) and max(sizes.values()) < IDS / count + 5 * math.sqrt(IDS / count)


def test_no_shards():
    with pytest.raises(ValueError, match="at least one"):
        sharding.placed(F.lit(1), 0)
