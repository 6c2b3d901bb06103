"""Token ids of documents in files, with a minimal perfect hash from document to ids.

Format. The documents are put in order of their ids by ranges and encoded; each
document ends with an id of its own. Every range is a *part*, cut into *shards*
of about two million bytes of ids or 65,536 documents (a longer document is a
shard of its own). A shard holds the raw ids of its documents one after another
(``payload``: unsigned, little-endian, of ``width`` bytes, two where the
vocabulary allows), where each document ends (``ends``), and its index: the bit
arrays of a minimal perfect hash over its document keys (``levels``) and a table
by slot (``slots``: fingerprint, first document, number of documents with that
key). ``first`` is the number of ids before the shard in its part. Shards are
rows of Parquet files, which every store that Spark knows can hold.

Access. A key is looked for in the shards whose range of keys has it; there its
slot is computed, the fingerprint compared and the ids cut out, all in constant
time. ``lookup`` does so for any keys: only shards with wanted keys meet them.
``read_documents`` does so for all the keys that the shards list.

Defined results: null and empty texts have the end id alone; equal ids are in
order of a hash of their texts, null ids come last and have no key; special
strings inside a text are special tokens, the library's default; extra columns
are ignored; an empty table gives no shard and an empty result. A key that is
not there is taken for one that is with a chance of 2**-32.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithic.llm import perfect_hash
from lithic.llm.chunks import SEAM, ByteLevel, Memory, slices, vocabulary_bytes, whole
from lithic.llm.common import modest_batches, new_path, table, text_bytes

END = 2
#: ids and documents of a shard at most, but for one longer document
SHARD_IDS, SHARD_DOCS = 1 << 20, 1 << 16
#: chunks remembered by a worker, of about 200 bytes each
CHUNKS = 3 << 19
#: bytes of text of a part; the most parts, which then are larger
PART_BYTES, MAX_PARTS = 16 << 20, 20_000
#: row groups of few shards, so that neither writer nor reader holds many
LAYOUT = {"compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "4", "parquet.page.size.row.check.min": "1"}
#: shards whose key ranges are broadcast at a time
ROUTES = 1 << 20

SHARD = "part int, shard int, first long, n_docs long, n_ids long, first_key long, last_key long, width int, keys array<long>, levels array<binary>, slots binary, ends binary, payload binary"
DOCUMENT = "doc_id long, start long, n_tokens long, ids_crc32 long"
_NAMES = [f.split()[0] for f in SHARD.split(", ")]


class Encoder:
    """Ids of texts as bytes, each text with the end id."""

    def __init__(self, content: bytes, end: int) -> None:
        self._level = ByteLevel(content)
        self.width = 2 if max(self._level.size, end + 1) <= 1 << 16 else 4
        self._end = self._bytes([end])
        self._memory = Memory(lambda chunks: self._level.chunk_ids(chunks, self._bytes, self.width), CHUNKS)

    def _bytes(self, ids) -> bytes:
        return np.asarray(ids, dtype=f"<u{self.width}").tobytes()

    def texts(self, texts: list[str]) -> list[bytes]:
        cut = [[] if any(s in t for s in self._level.special) else t.split(" ") for t in texts]
        known = self._memory.known([c[1:] for c in cut])
        heads = list({c[0] for c in cut if c})
        encoded = self._level.tokenizer.encode_batch_fast(heads, add_special_tokens=False) if heads else []
        head = {h: self._bytes(e.ids) if not h or whole(h) else None for h, e in zip(heads, encoded, strict=True)}
        return [self._put_together(t, [head[c[0]], *map(known.__getitem__, c[1:])] if c else None) + self._end for t, c in zip(texts, cut, strict=True)]

    def _put_together(self, text: str, values: list | None) -> bytes:
        if values is None:  # special strings
            return self._bytes(self._level.ids(text))
        if values == [b""]:
            return b""
        if None in values or not values[0]:  # white space beside a blank: only seams cut
            chunks = SEAM.split(text)
            values = [self._bytes(self._level.ids(" " * (i > 0) + c)) for i, c in enumerate(chunks)]
        return b"".join(values)


@lru_cache(maxsize=2)
def _encoder(content: bytes, end: int) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(content, end)


def shard_row(part: int, number: int, first: int, keys: list[int | None], ids: list[bytes], width: int) -> list:
    """A shard of documents in order of their keys, nulls last."""
    ends = np.cumsum([len(i) // width for i in ids], dtype=np.int64)
    own = np.array([k for k in keys if k is not None], dtype=np.int64)
    distinct, at, times = np.unique(own, return_index=True, return_counts=True)
    levels, index = perfect_hash.build(distinct), np.zeros((len(distinct), 3), dtype="<u4")
    index[perfect_hash.slots(levels, distinct)] = np.stack([perfect_hash.fingerprints(distinct), at, times], axis=1)
    bounds = (int(own[0]), int(own[-1])) if len(own) else (None, None)
    return [part, number, first, len(keys), int(ends[-1]), *bounds, width, keys, levels, index.tobytes(), ends.astype("<i8").tobytes(), b"".join(ids)]


def _write_shards(vocabulary, end: int, shard_ids: int):
    schema = pa.schema([(n, t) for n, t in zip(_NAMES, [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()), *[pa.binary()] * 3], strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value, end)
        part, number, first, held, keys, ids = TaskContext.get().partitionId(), 0, 0, 0, [], []

        def shard() -> pa.RecordBatch:
            row = shard_row(part, number, first, keys, ids, encoder.width)
            return pa.record_batch([pa.array([v], type=f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            names, at = batch.column("doc_id").to_pylist(), 0
            for texts in slices(batch.column("text")):
                for key, encoded in zip(names[at : at + len(texts)], encoder.texts(texts), strict=True):
                    size = len(encoded) // encoder.width
                    if keys and (held + size > shard_ids or len(keys) >= SHARD_DOCS):
                        yield shard()
                        number, first, held, keys, ids = number + 1, first + held, 0, [], []
                    keys.append(key)
                    ids.append(encoded)
                    held += size
                at += len(texts)
        if keys:
            yield shard()

    return run


class Shard:
    """One shard as read back: documents by key through the index."""

    def __init__(self, row: dict) -> None:
        self._levels, self._table = row["levels"], np.frombuffer(row["slots"], dtype="<u4").reshape(-1, 3)
        self.ends = np.frombuffer(row["ends"], dtype="<i8")
        self._ids = np.frombuffer(row["payload"], dtype=f"<u{row['width']}")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which key, its first document, how many) of the keys that are here."""
        slot = perfect_hash.slots(self._levels, keys)
        at = np.flatnonzero(slot >= 0)
        at = at[self._table[slot[at], 0] == perfect_hash.fingerprints(keys[at])]
        return at, self._table[slot[at], 1].astype(np.int64), self._table[slot[at], 2].astype(np.int64)

    def ids(self, document: int) -> np.ndarray:
        return self._ids[self.start(document) : self.ends[document]].astype("<u4")

    def start(self, document: int) -> int:
        return int(self.ends[document - 1]) if document else 0


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows_of(batches):
        shard, out = Shard(row), []
        keys = np.unique(np.array([k for k in row["keys"] if k is not None], dtype=np.int64))
        documents = [(int(keys[k]), d) for k, first, n in zip(*shard.find(keys), strict=True) for d in range(first, first + n)]
        documents += [(None, d) for d, k in enumerate(row["keys"]) if k is None]
        for key, d in documents:
            ids = shard.ids(d)
            out.append((key, row["before"] + row["first"] + shard.start(d), len(ids), zlib.crc32(ids.tobytes())))
        yield pa.record_batch([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end: int = END, shard_ids: int = SHARD_IDS) -> None:
    """The ids of docs(doc_id, text) as shards under ``path``; ``vocabulary`` is a byte-level file."""
    spark = docs.sparkSession
    modest_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, min(MAX_PARTS, -(-text_bytes(rows) // PART_BYTES)))
    # equal rows are dealt out too: their order does not matter, but one range may not hold them all
    rows = rows.withColumns({"last": F.col("doc_id").isNull(), "tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ["last", "doc_id", "tie", "row"]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.mapInArrow(_write_shards(shared, end, shard_ids), SHARD).write.options(**LAYOUT).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document under ``path``."""
    shards = spark.read.schema(SHARD).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # at most MAX_PARTS rows
    before = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return shards.join(F.broadcast(before), "part").mapInArrow(_read_shards, DOCUMENT)


def _route(bounds):
    """Lists of keys for each shard whose range holds them, from one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, first, last = bounds.value
        for batch in batches:
            keys = np.sort(batch.column(0).to_numpy())
            low, high = np.searchsorted(last, keys, "left"), np.searchsorted(first, keys, "right")
            lists: dict[int, list[int]] = {}
            for key, i, j in zip(keys.tolist(), low, high, strict=True):
                for s in range(i, j):
                    lists.setdefault(s, []).append(key)
            if lists:
                at = place[list(lists)]
                yield pa.record_batch([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(list(lists.values()), type=pa.list_(pa.int64()))], names=["part", "shard", "wanted"])

    return run


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows_of(batches):
        shard, wanted = Shard(row), np.array(row["wanted"], dtype=np.int64)
        found = [(int(wanted[k]), shard.ids(d)) for k, first, n in zip(*shard.find(wanted), strict=True) for d in range(first, first + n)]
        if found:
            yield pa.record_batch([pa.array([k for k, _ in found]), pa.array([i.astype(np.int64) for _, i in found], type=pa.list_(pa.int64()))], names=["doc_id", "ids"])


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents under ``path`` that keys(doc_id) asks for, each once; unknown keys give no row."""
    shards = spark.read.schema(SHARD).parquet(path)
    bounds = shards.where("first_key is not null").select("part", "shard", "first_key", "last_key")
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    found, n_slices = None, -(-bounds.count() // ROUTES) or 1
    for k in range(n_slices):
        held = bounds.where(F.pmod(F.xxhash64("part", "shard"), F.lit(n_slices)) == k).toArrow().sort_by([("part", "ascending"), ("shard", "ascending")])
        shared = spark.sparkContext.broadcast((np.stack([held["part"].to_numpy(), held["shard"].to_numpy()], axis=1), held["first_key"].to_numpy(), held["last_key"].to_numpy()))
        lists = wanted.mapInArrow(_route(shared), "part int, shard int, wanted array<long>")
        hits = shards.select("part", "shard", "width", "levels", "slots", "ends", "payload").join(lists, ["part", "shard"]).mapInArrow(_fetch, "doc_id long, ids array<long>")
        found = hits if found is None else found.unionByName(hits)
    return found


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents' ids into files and back."""
    import public_tokenizers

    path = new_path(spark, "ids")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path)
