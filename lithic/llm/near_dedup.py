"""Near-duplicate groups: circulant MinHash, banding, exact Jaccard.

1. ``profiles``: each text becomes the set of its word shingles (hashed); two
   permutations give all signature coordinates. ``sigma`` scatters the shingles
   over a ring of 2**32 places; coordinate k is the least value of ``pi`` at
   the places shifted round the ring by k.
2. Texts with equal sets form a class; only its least id goes on, so copies
   never meet in a bucket.
3. Every band of a signature links a class to the least class in its bucket.
   The components of these links are candidate clusters. They hold every pair
   that shares a bucket, so nothing is lost by linking to one member alone.
4. Inside a cluster pairs are counted exactly on the full sets, in blocks of
   about ``BLOCK`` classes, so that a cluster of any size is spread over many
   tasks. First every block is compared within itself and with the cluster's
   least class. Classes that are linked by then need no more comparing among
   themselves: only those outside the largest linked part of their cluster meet
   all blocks, block against block.
5. Texts that share half of their words meet in some bucket of the first bands,
   so common boilerplate makes large clusters of texts that are not linked. Where
   so many classes are outside the largest linked part that meeting all blocks
   would cost more than further bands, the cluster's classes get bands of twice
   as many rows from further coordinates, which such texts hardly ever share, and
   only classes of different linked parts that share one of those buckets are
   compared. The true links' components are the result.

Defined results: a null or empty text and a text without words have no
shingles and no link; a row without doc_id has no link (component null, kept
true); rows with the same doc_id count as one document, each gets its row;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm import textops as T
from lithic.llm.common import drop_saved, free_prefix, modest_batches, save, table
from lithic.llm.components import connected_components

BLOCK = 128
#: chance of missing one pair exactly at the threshold
MISS = 1e-6
_U = np.uint64


def bands_for(percent: int, rows: int) -> int:
    """Bands needed so that a pair at the threshold is missed with at most MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows))


def shingle_sets(piece: T.Slice, hasher: T.WordHasher, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one after the other, and row offsets."""
    starts, ends, ranges = piece.words(T.WORD)
    words = hasher.ranges(piece.data, starts, ends)
    grams = T.ngrams(words, n)
    sets = []
    for a, b in zip(ranges[:-1].tolist(), ranges[1:].tolist(), strict=True):
        if b - a >= n:
            sets.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            sets.append(T.ngrams(words[a:b], b - a) ^ _U(b - a))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    offsets = np.zeros(len(sets) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64), offsets


def signatures(shingles: np.ndarray, offsets: np.ndarray, coordinates: int, first: int = 0) -> np.ndarray:
    """Circulant MinHash of non-empty sets: (rows, coordinates), those from ``first`` on."""
    out = np.empty((len(offsets) - 1, coordinates), dtype=np.uint32)
    place = (T.mix(shingles) >> _U(32)).astype(np.uint32)  # sigma
    a, b = np.empty_like(place), np.empty_like(place)
    for k in range(coordinates):
        np.add(place, np.uint32(first + k), out=a)  # the ring turned by k
        np.right_shift(a, np.uint32(16), out=b)  # pi: a bijection on the ring
        a ^= b
        a *= np.uint32(0x7FEB352D)
        np.right_shift(a, np.uint32(15), out=b)
        a ^= b
        a *= np.uint32(0x846CA68B)
        np.right_shift(a, np.uint32(16), out=b)
        a ^= b
        out[:, k] = np.minimum.reduceat(a, offsets[:-1])
    return out


def _band_keys(shingles: np.ndarray, at: np.ndarray, bands: int, rows: int, first: int = 0) -> np.ndarray:
    """A key for each band of each non-empty set: (sets, bands)."""
    sig = signatures(shingles, at, bands * rows, first).astype(np.uint64)
    keys = np.zeros((len(sig), bands), dtype=np.uint64)
    for j in range(bands):
        key = np.full(len(sig), first + j + 1, dtype=np.uint64)
        for k in range(j * rows, (j + 1) * rows):
            key = T.mix(key * _U(0x9E3779B97F4A7C15) + sig[:, k])
        keys[:, j] = key
    return keys


def _profile_batches(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = T.WordHasher(3, fold_case=True)
        for batch in batches:
            ids = batch.column(0)
            for piece in T.slices(batch.column(1)):
                shingles, offsets = shingle_sets(piece, hasher, n)
                sizes = np.diff(offsets)
                full = np.flatnonzero(sizes)
                digest = np.zeros((2, piece.rows), dtype=np.uint64)
                keys = np.zeros((len(full), bands), dtype=np.uint64)
                if len(full):
                    at = np.append(offsets[full], offsets[-1])
                    for lane, salt in enumerate((0x51ED270B, 0xB5297A4D)):
                        digest[lane, full] = np.add.reduceat(T.mix(shingles ^ _U(salt)), at[:-1])
                    keys = _band_keys(shingles, at, bands, rows)
                count = np.zeros(piece.rows + 1, dtype=np.int32)
                count[1:] = np.cumsum(np.where(sizes > 0, bands, 0))
                yield pa.record_batch(
                    [
                        ids.slice(piece.first, piece.rows),
                        pa.array(sizes),
                        pa.array(digest[0].view(np.int64)),
                        pa.array(digest[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(count), pa.array(keys.ravel().view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "c1", "c2", "bands"],
                )

    return run


def _finer_batches(bands: int, rows: int, first: int):
    """Keys of further bands of non-empty sets(node, part, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                sets, size, to = [], 0, at
                while to < batch.num_rows and size < T.SLICE_BYTES // 8:
                    sets.append(np.frombuffer(batch.column(2)[to].as_buffer(), dtype=np.uint64))
                    size += len(sets[-1])
                    to += 1
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                keys = _band_keys(np.concatenate(sets), offsets, bands, rows, first)
                cuts = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands)
                yield pa.record_batch([*(batch.column(k).slice(at, to - at) for k in (0, 1)), pa.ListArray.from_arrays(cuts, pa.array(keys.ravel().view(np.int64)))], names=["node", "part", "bands"])
                at = to

    return run


def _set_batches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = T.WordHasher(3, fold_case=True)
        for batch in batches:
            for piece in T.slices(batch.column(2)):
                shingles, offsets = shingle_sets(piece, hasher, n)
                raw = [shingles[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.record_batch([*(batch.column(k).slice(piece.first, piece.rows) for k in (0, 1)), pa.array(raw, type=pa.binary())], names=["node", "cluster", "shingles"])

    return run


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Local component (least position) of each set under the Jaccard threshold."""
    sizes = np.array([len(s) for s in sets])
    parent = np.arange(len(sets))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    holders = owner[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(flat))])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    for d in range(1, len(sets)):
        mine = flat[offsets[d] : offsets[d + 1]]
        lo, length = begin[mine], begin[mine + 1] - begin[mine]
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        both = np.bincount(holders[at], minlength=len(sets))[:d]
        for other in np.flatnonzero(100 * both >= percent * (sizes[:d] + sizes[d] - both)).tolist():
            a, b = root(d), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return np.array([root(x) for x in range(len(sets))])


def _verify(percent: int):
    def run(group: pa.Table) -> pa.Table:
        frame = group.select(["cluster", "node", "shingles"]).sort_by([("cluster", "ascending"), ("node", "ascending")])
        clusters = frame.column("cluster").to_numpy()
        nodes = frame.column("node").to_numpy()
        raw = frame.column("shingles").combine_chunks()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(clusters)) + 1, [len(clusters)]])
        a, b = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo > 1:
                sets = [np.frombuffer(raw[k].as_py(), dtype=np.uint64) for k in range(lo, hi)]
                low = linked(sets, percent)
                own = nodes[lo:hi]
                far = own != own[low]
                a.append(own[far])
                b.append(own[low][far])
        none = np.zeros(0, dtype=np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return run


def _bucket_clusters(buckets: DataFrame) -> DataFrame:
    """(node, component) of the classes(class_id, key) that share keys, the least class of each component left out."""
    hubs = save(buckets.groupBy("key").agg(F.min("class_id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub"), "hubs")
    found = connected_components(buckets.join(hubs, "key").select(F.col("class_id").alias("a"), F.col("hub").alias("b")))
    drop_saved(hubs)
    return found


def _sizes(clusters: DataFrame) -> DataFrame:
    return save(clusters.groupBy("component").agg((F.count(F.lit(1)) + 1).alias("members")), "sizes")


def _members(clusters: DataFrame, some: DataFrame) -> DataFrame:
    """(node, component) of all classes in some clusters, the least ones included."""
    own = clusters.join(some.select("component"), "component", "left_semi").select("node", "component")
    return own.unionByName(some.select(F.col("component").alias("node"), "component"))


def _first_links(sets: DataFrame, percent: int, sizes: DataFrame) -> DataFrame:
    """Links inside each block and to the least class of the cluster."""
    total = sizes.agg(F.sum("members")).first()[0] or 0
    least = F.when(F.col("node") == F.col("cluster"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    spread = max(1, total // 512)  # clusters of one block share tasks
    block = F.explode(least).alias("block")
    key = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(spread))).otherwise(F.xxhash64("cluster", "block"))
    tasks = sets.select("node", "cluster", "shingles", "blocks", block).select("node", "cluster", "shingles", key.alias("task"))
    return tasks.groupBy("task").applyInArrow(_verify(percent), "a long, b long")


def _in_blocks(sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """sets(node, cluster, shingles) with the number of blocks of their cluster and the block they are in."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    joined = sets.join(sizes, F.col("cluster") == F.col("component"))
    return joined.select("node", "cluster", "shingles", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"))


def _open(sets: DataFrame, known: DataFrame, most: int) -> DataFrame | None:
    """Classes of clusters of several blocks that are not linked throughout; None without such clusters.

    group: for classes outside the largest linked part the group that meets all
    blocks; chained: whether there are more than ``most`` such groups.
    """
    several = sets.where("blocks > 1").select("node", "cluster", "blocks", "own")
    if several.isEmpty():
        return None
    placed = save(several.join(known, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"), "placed")
    parts = placed.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"))
    best = parts.groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("best"), (F.sum("n") - F.max("n")).alias("outside")).where("outside > 0")
    groups = F.ceil(F.col("outside") / BLOCK).cast("int")
    best = best.select("cluster", "best", groups.alias("groups"), (groups > most).alias("chained"))
    group = F.when(F.col("part") != F.col("best"), F.pmod(F.xxhash64("node", F.lit("group")), F.col("groups")).cast("int"))
    found = save(placed.join(best, "cluster").withColumn("group", group).select("node", "cluster", "blocks", "own", "part", "groups", "group", "chained"), "open")
    drop_saved(placed)
    return None if found.isEmpty() else found


def _between_blocks(sets: DataFrame, open_: DataFrame, percent: int) -> DataFrame:
    """Links of the classes outside the largest linked part of their cluster with all its classes."""
    every = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda g: F.struct(F.col("own").alias("block"), g.alias("group")))
    out = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("block"), F.col("group")))
    tasks = F.when(F.col("group").isNull(), every).otherwise(F.array_distinct(F.concat(every, out)))
    spread = open_.select("node", F.explode(tasks).alias("t"))
    sent = sets.select("node", "cluster", "shingles").join(spread, "node").select("node", "cluster", "shingles", F.xxhash64("cluster", "t.block", "t.group").alias("task"))
    return save(sent.groupBy("task").applyInArrow(_verify(percent), "a long, b long"), "links")


def _shared_buckets(keys: DataFrame) -> DataFrame:
    """keys(node, part, key) in buckets that hold more than one part, with the bucket's size."""
    several = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key", "members")
    return save(keys.select("node", "key").join(several, "key"), "buckets")


def _within_buckets(sets: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """Links of classes that share one of the buckets(node, key, members)."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    placed = sets.select("node", "shingles").join(buckets, "node").select("node", F.col("key").alias("cluster"), "shingles", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"))
    spread = max(1, buckets.count() // 512)
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(spread))).otherwise(F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")))
    return save(each.select("node", "cluster", "shingles", task.alias("task")).groupBy("task").applyInArrow(_verify(percent), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept for every row of docs(doc_id, text).

    Links join texts whose shingle sets have 100 * intersection >= percent * union.
    """
    modest_batches(docs.sparkSession)
    bands = bands_for(percent, rows)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profiles = save(docs.mapInArrow(_profile_batches(n, bands, rows), "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>"), "profiles")
    some = profiles.where("n_shingles > 0 and doc_id is not null")
    classes = save(some.groupBy("c1", "c2").agg(F.min("doc_id").alias("class_id"), F.min_by("bands", "doc_id").alias("bands")), "classes")

    clusters = save(_bucket_clusters(classes.select("class_id", F.explode("bands").alias("key"))), "clusters")
    sizes = _sizes(clusters)
    # one row a document where rows repeat an id; only the cluster members' texts are read on
    members = _members(clusters, sizes)
    texts = docs.join(members, docs.doc_id == members.node).select("node", F.col("component").alias("cluster"), "text")
    sets = save(_in_blocks(texts.mapInArrow(_set_batches(n), "node long, cluster long, shingles binary"), sizes), "sets")
    links = save(_first_links(sets, percent, sizes), "links")
    components = connected_components(links)
    finer = bands_for(percent, 2 * rows)
    open_ = _open(sets, components, finer // 2)
    if open_ is not None:
        links = links.unionByName(_between_blocks(sets, open_.where("not chained"), percent))
        chained = open_.where("chained")
        if not chained.isEmpty():
            keys = sets.join(chained.select("node", "part"), "node").select("node", "part", "shingles").mapInArrow(_finer_batches(finer, 2 * rows, bands * rows), "node long, part long, bands array<long>")
            buckets = _shared_buckets(keys.select("node", "part", F.explode("bands").alias("key")))
            links = links.unionByName(_within_buckets(sets, buckets, percent))
        components = connected_components(links)

    to_class = profiles.join(classes.select("c1", "c2", "class_id"), ["c1", "c2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
    found = to_class.join(components, F.col("class_id") == components.node, "left")
    component = F.coalesce("component", "class_id")
    return found.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.85, over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85, rows=6).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicate rows, with all its columns.

    Rows are linked by their texts alone: each gets a number of its own, so rows
    that repeat an id or have none are rows like others, and a row is never
    dropped for what another row with its id says. Of a group the row with the
    least id stays, rows without an id last. Rows without words are all kept.
    Extra columns are kept whatever their names.
    """
    row = f"{free_prefix(docs)}row"
    keyed = save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"), n, percent)
    ids = keyed.select(F.col(row).alias("_own"), F.col("doc_id").cast("long").alias("_id"))
    linked = found.where("doc_id <> component_id").select("doc_id", "component_id")
    linked = save(linked.unionByName(linked.select(F.col("component_id").alias("doc_id"), "component_id").distinct()), "linked")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_own").alias("row"))
    first = linked.join(ids, F.col("doc_id") == F.col("_own")).groupBy("component_id").agg(F.min(order).alias("m")).select(F.col("m.row").alias("doc_id"))
    gone = save(linked.join(first, "doc_id", "left_anti").select(F.col("doc_id").alias(row)), "dropped")
    drop_saved(linked)
    return keyed.join(gone, row, "left_anti").select(docs.columns)
