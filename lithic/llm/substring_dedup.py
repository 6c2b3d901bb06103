"""Removal of word windows that occur more than once in the corpus.

1. Sketch. Every window of ``window`` words is represented by its anchor: the
   least hash among the ``ANCHOR``-word grams inside it. Equal windows have
   equal anchors at different places, so the number of places of an anchor is
   never below the number of places of any window it stands for. Each task
   counts its anchor places in a count-min sketch of two rows; the sketches
   are merged cell by cell. The merged counts overestimate window counts.
2. Only windows estimated at two or more go on. Each task first groups its own:
   what repeats inside one task is decided there and one row is sent for all,
   so a window shared by any number of documents sends at most one row a task.
3. The rows are grouped exactly on 96-bit fingerprints of the whole windows.
   Confirmed places come together by document and are cut from the texts.

The sketch has about one cell for eight bytes of text, however large the corpus.
Up to ``MAX_CELLS`` cells a row its bits are broadcast, at most 128 MB. A larger
one stays where it was merged, dealt out by cells: tasks send it the anchors
that they hold in one document alone, and the answers come back by document.

Defined results: a null or empty text has no words and keeps the empty text;
a text shorter than a window is kept whole; rows repeated with the same id and
text count as separate occurrences, so both lose their windows; doc_id may be
null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm import textops as T
from lithic.llm.common import modest_batches, save, table, text_bytes

ANCHOR = 18
ROWS = 2
MAX_CELLS = 1 << 29
BLOCK_CELLS = 1 << 20
#: windows or anchors that a task holds before it sends what it has
HOLD = 1 << 20
_U = np.uint64


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = op(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return op(x[: len(x) - rest], x[rest:]) if rest else x


class _Windows:
    """Windows of a slice: which starts are whole, their anchors, anchor places."""

    def __init__(self, piece: T.Slice, hasher: T.WordHasher, window: int, anchor: int) -> None:
        starts, ends, self.ranges = piece.words(T.WORD)
        self.words = hasher.ranges(piece.data, starts, ends)
        total = len(self.words)
        self.whole = T.window_starts(self.ranges, window, total)
        self.grams = T.ngrams(self.words, anchor)
        self.span = window - anchor + 1
        self.anchors = _sliding(np.minimum, self.grams, self.span) if len(self.whole) else self.grams[:0]

    def places(self) -> np.ndarray:
        """The anchor of each place that is the anchor of some whole window."""
        return self.grams[self.place_at()]

    def place_at(self) -> np.ndarray:
        """Words at which the anchor of some whole window starts."""
        if not len(self.whole):
            return np.zeros(0, dtype=np.int64)
        low = np.where(self.whole, self.anchors, _U(0))
        pad = np.zeros(self.span - 1, dtype=np.uint64)
        most = _sliding(np.maximum, np.concatenate([pad, low, pad]), self.span)
        return np.flatnonzero((most == self.grams) & (most > 0))


def _cells(anchors: np.ndarray, row: int, width: int) -> np.ndarray:
    return T.mix(anchors ^ _U(0x5851F42D4C957F2D + row)) & _U(width - 1)


def _sketch_batches(window: int, anchor: int, width: int, rows: int):
    block = block_cells(width)
    blocks = width // block

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        anchors = np.concatenate(held)
        keys, once, more = [], [], []
        for row in range(rows):
            cells, counts = np.unique(_cells(anchors, row, width), return_counts=True)
            parts, first = np.unique(cells // _U(block), return_index=True)
            for b, lo, hi in zip(parts.tolist(), first.tolist(), [*first[1:].tolist(), len(cells)], strict=True):
                own, n = (cells[lo:hi] % _U(block)).astype(np.uint32), counts[lo:hi]
                keys.append(row * blocks + b)
                once.append(own[n == 1].tobytes())
                more.append(own[n > 1].tobytes())
        return pa.record_batch([pa.array(keys, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["block", "once", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = T.WordHasher(10)
        held, size = [], 0
        for batch in batches:
            for piece in T.slices(batch.column(0)):
                held.append(_Windows(piece, hasher, window, anchor).places())
                size += len(held[-1])
                if size >= HOLD:
                    yield send(held)
                    held, size = [], 0
        if size:
            yield send(held)

    return run


def _merge_block(block: int):
    def run(group: pa.Table) -> pa.Table:
        twice = np.zeros(block, dtype=bool)
        seen = np.zeros(block, dtype=bool)
        for once, more in zip(group.column("once").to_pylist(), group.column("more").to_pylist(), strict=True):
            cells = np.frombuffer(once, dtype=np.uint32)
            twice[cells[seen[cells]]] = True
            seen[cells] = True
            cells = np.frombuffer(more, dtype=np.uint32)
            twice[cells] = True
            seen[cells] = True
        return pa.table({"block": group.column("block")[:1], "bits": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})

    return run


def block_cells(width: int) -> int:
    """Cells of one part of a sketch row."""
    return min(width, max(BLOCK_CELLS, width >> 16))


def merged_sketch(docs: DataFrame, window: int, anchor: int, width: int, rows: int = ROWS) -> DataFrame:
    """Parts of the sketch, rows of (block, bits): which cells hold two places or more."""
    parts = docs.select("text").mapInArrow(_sketch_batches(window, anchor, width, rows), "block int, once binary, more binary")
    return parts.groupBy("block").applyInArrow(_merge_block(block_cells(width)), "block int, bits binary")


def collected_sketch(merged: DataFrame, width: int) -> list[np.ndarray]:
    """A bitmap for each row of a sketch of at most MAX_CELLS cells a row."""
    block = block_cells(width)
    bits = np.zeros((ROWS * (width // block), block // 8), dtype=np.uint8)
    for row in merged.collect():
        bits[row.block] = np.frombuffer(row.bits, dtype=np.uint8)
    return [half.reshape(-1) for half in np.split(bits, ROWS)]


def _ask_batches(window: int, anchor: int, width: int):
    """Anchors of documents by part of the sketch; block -1 for those that repeat in what a task holds."""
    block = block_cells(width)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        anchors, k1, k2 = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((k2, k1, anchors))
        anchors, k1, k2 = anchors[order], k1[order], k2[order]
        same = anchors[1:] == anchors[:-1]
        again = np.append(same, False) | np.append(False, same)
        part = np.where(again, -1, (_cells(anchors, 0, width) // _U(block)).astype(np.int64))
        order = np.lexsort((k2, k1, part))
        part, anchors, k1, k2 = part[order], anchors[order], k1[order], k2[order]
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        columns: list[list] = [[], [], [], []]
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True):
            first, n = _runs(k1[a:b], k2[a:b])
            for column, x in zip(columns, (k1[a:b][first], k2[a:b][first], n.astype(np.int32), anchors[a:b]), strict=True):
                column.append(x.tobytes())
        return pa.record_batch([pa.array(part[cut], pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["block", "k1", "k2", "n", "anchors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = T.WordHasher(10)
        held, size = [], 0
        for batch in batches:
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            for piece in T.slices(batch.column(2)):
                w = _Windows(piece, hasher, window, anchor)
                own = w.places()  # each place once, so what repeats inside a document repeats here too
                if not len(own):
                    continue
                row = np.searchsorted(w.ranges, w.place_at(), side="right") - 1
                held.append((own, keys[0][piece.first + row], keys[1][piece.first + row]))
                size += len(own)
                if size >= HOLD:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _anchor_rows(k1: np.ndarray, k2: np.ndarray, anchors: np.ndarray) -> pa.Table:
    order = np.lexsort((k2, k1))
    k1, k2, anchors = k1[order], k2[order], anchors[order]
    first, n = _runs(k1, k2)
    return pa.table({"k1": k1[first], "k2": k2[first], "anchors": pa.array([anchors[a : a + m].tobytes() for a, m in zip(first.tolist(), n.tolist(), strict=True)], pa.binary())})


def _asked(rows: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    got = [np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=kind) for c, kind in (("k1", np.int64), ("k2", np.int64), ("n", np.int32), ("anchors", np.uint64))]
    return [np.repeat(got[0], got[2]), np.repeat(got[1], got[2]), got[3]]


def _answer(width: int):
    block = block_cells(width)

    def run(asks: pa.Table, bits: pa.Table) -> pa.Table:
        if not asks.num_rows:
            return _anchor_rows(*(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64)))
        k1, k2, anchors = _asked(asks)
        cell = _cells(anchors, 0, width) % _U(block)
        held = np.frombuffer(bits.column("bits")[0].as_py(), dtype=np.uint8)
        yes = (held[(cell >> _U(3)).astype(np.int64)] >> (cell & _U(7)).astype(np.uint8)) & 1 == 1
        return _anchor_rows(k1[yes], k2[yes], anchors[yes])

    return run


def _known_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _anchor_rows(*_asked(batch)).to_batches()


def repeated_anchors(keyed: DataFrame, window: int, anchor: int, width: int) -> DataFrame:
    """(k1, k2, anchors): for each document the anchors that a sketch of any size estimates at two or more."""
    bits = merged_sketch(keyed, window, anchor, width, 1)
    rows = save(keyed.select("k1", "k2", "text").mapInArrow(_ask_batches(window, anchor, width), "block int, k1 binary, k2 binary, n binary, anchors binary"), "asks")
    out = "k1 long, k2 long, anchors binary"
    known = rows.where("block < 0").mapInArrow(_known_batches, out)
    told = rows.where("block >= 0").groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(_answer(width), out)
    return known.unionByName(told).groupBy("k1", "k2").agg(F.collect_list("anchors").alias("anchors"))


_PLACES = "bucket int, send boolean, h binary, lane binary, k1 binary, k2 binary, n binary, pos binary"


def _runs(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of stretches with the same key pair."""
    cut = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])) if len(k1) else np.zeros(0, dtype=np.int64)
    return cut, np.diff(np.append(cut, len(k1)))


def _groups(h: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by fingerprint, group number of each ordered row, group sizes."""
    order = np.lexsort((lane, h))
    h, lane = h[order], lane[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (lane[1:] != lane[:-1])])
    number = np.cumsum(fresh) - 1
    return order, number, np.bincount(number)


def _place_batches(window: int, anchor: int, width: int, buckets: int, sketch):
    def pack(rows: dict[int, list], bucket: np.ndarray, send: bool, h, lane, k1, k2, pos) -> None:
        order = np.lexsort((pos, k2, k1, bucket))
        bucket, k1, k2, pos = bucket[order], k1[order], k2[order], pos[order]
        if send:
            h, lane = h[order], lane[order]
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            part = slice(cut[b], cut[b + 1])
            first, n = _runs(k1[part], k2[part])
            values = [h[part].tobytes(), lane[part].tobytes()] if send else [b"", b""]
            values += [x.tobytes() for x in (k1[part][first], k2[part][first], n.astype(np.int32), pos[part])]
            for name, value in zip(rows, [b, send, *values], strict=True):
                rows[name].append(value)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        h, lane, k1, k2, pos = (np.concatenate(x) for x in zip(*held, strict=True))
        order, number, sizes = _groups(h, lane)
        many = (sizes > 1)[number]
        lead = np.concatenate([[True], number[1:] != number[:-1]])
        rows: dict[str, list] = {x.split()[0]: [] for x in _PLACES.split(", ")}
        # decided here: no need to meet other tasks' rows, dealt out by document
        own = order[many]
        pack(rows, ((k1[own] ^ k2[own]).view(np.uint64) % _U(buckets)).astype(np.int64), False, None, None, k1[own], k2[own], pos[own])
        # one row for each fingerprint; a position below zero says that it is repeated already
        one = order[lead]
        pack(rows, (h[one] % _U(buckets)).astype(np.int64), True, h[one], lane[one], k1[one], k2[one], np.where(many[lead], -1 - pos[one], pos[one]).astype(np.int32))
        schema = pa.schema([("bucket", pa.int32()), ("send", pa.bool_()), *((x, pa.binary()) for x in ("h", "lane", "k1", "k2", "n", "pos"))])
        return pa.record_batch([pa.array(rows[f.name], f.type) for f in schema], schema=schema)

    def estimated(w: _Windows, batch: pa.RecordBatch, first: int) -> np.ndarray:
        """Which windows of a slice are estimated at two or more."""
        hope = w.whole.copy()
        if sketch is None:  # answers came with the documents
            for row, (a, b) in enumerate(zip(w.ranges[:-1].tolist(), np.minimum(w.ranges[1:], len(hope)).tolist(), strict=True)):
                if a < b:
                    hope[a:b] &= np.isin(w.anchors[a:b], np.frombuffer(b"".join(batch.column(3)[first + row].as_py()), dtype=np.uint64))
            return hope
        for row, bits in enumerate(sketch.value):
            cell = _cells(w.anchors, row, width)
            hope &= (bits[(cell >> _U(3)).astype(np.int64)] >> (cell & _U(7)).astype(np.uint8)) & 1 == 1
        return hope

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = T.WordHasher(10)
        held, size = [], 0
        for batch in batches:
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            for piece in T.slices(batch.column(2)):
                w = _Windows(piece, hasher, window, anchor)
                at = np.flatnonzero(estimated(w, batch, piece.first))
                if len(at):
                    owner = np.searchsorted(w.ranges, at, side="right") - 1
                    pos = (at - w.ranges[owner]).astype(np.int32)
                    lane = (T.ngrams(T.mix(w.words ^ _U(0xA0761D6478BD642F)), window)[at] >> _U(32)).astype(np.uint32)
                    held.append((T.ngrams(w.words, window)[at], lane, keys[0][piece.first + owner], keys[1][piece.first + owner], pos))
                    size += len(at)
                if size >= HOLD:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


_MARKS = "bucket int, k1 binary, k2 binary, n binary, pos binary"


def _unpack(group: pa.Table, only: np.ndarray) -> list[np.ndarray]:
    """k1, k2 and pos of the chosen rows, one value for each place."""
    got = []
    for name, kind in (("k1", np.int64), ("k2", np.int64), ("n", np.int32), ("pos", np.int32)):
        column = group.column(name).to_pylist()
        got.append(np.frombuffer(b"".join(column[k] for k in only.tolist()), dtype=kind))
    return [np.repeat(got[0], got[2]), np.repeat(got[1], got[2]), got[3]]


def _exact(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        sent = group.column("send").to_numpy()
        k1, k2, pos = _unpack(group, np.flatnonzero(~sent))
        if sent.any():
            rows = np.flatnonzero(sent).tolist()
            h, lane = (np.frombuffer(b"".join(group.column(x)[k].as_py() for k in rows), dtype=kind) for x, kind in (("h", np.uint64), ("lane", np.uint32)))
            a, b, p = _unpack(group, np.flatnonzero(sent))
            order, number, sizes = _groups(h, lane)
            repeated = order[(sizes > 1)[number]]
            repeated = repeated[p[repeated] >= 0]
            k1, k2, pos = (np.concatenate([x, y[repeated]]) for x, y in ((k1, a), (k2, b), (pos, p)))
        bucket = ((k1 ^ k2).view(np.uint64) % _U(buckets)).astype(np.int64)
        order = np.lexsort((pos, k2, k1, bucket))
        bucket, k1, k2, pos = bucket[order], k1[order], k2[order], pos[order]
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cut)).tolist()
        columns = [[], [], [], []]
        for b in some:
            part = slice(cut[b], cut[b + 1])
            first, n = _runs(k1[part], k2[part])
            for column, x in zip(columns, (k1[part][first], k2[part][first], n.astype(np.int32), pos[part]), strict=True):
                column.append(x.tobytes())
        return pa.table([pa.array(some, pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], names=["bucket", "k1", "k2", "n", "pos"])

    return run


def _by_document(group: pa.Table) -> pa.Table:
    k1, k2, pos = _unpack(group, np.arange(group.num_rows))
    order = np.lexsort((pos, k2, k1))
    k1, k2, pos = k1[order], k2[order], pos[order]
    first, n = _runs(k1, k2)
    starts = [np.unique(pos[a : a + k]).tobytes() for a, k in zip(first.tolist(), n.tolist(), strict=True)]
    return pa.table({"k1": k1[first], "k2": k2[first], "starts": pa.array(starts, pa.binary())})


def _cut_batches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                if starts.is_valid and words:
                    at = np.frombuffer(starts.as_py(), dtype=np.int32)
                    gone = T.covered(at[at < len(words)].astype(np.int64), window, len(words))
                    words = list(compress(words, (~gone).tolist()))
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = 50, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text for every row of docs(doc_id, text).

    A word goes if a window of ``window`` words that covers it also starts
    anywhere else. Words are runs of non-space characters.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    anchor = min(anchor, window)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = text_bytes(docs)
    width = 1 << 16
    while width * 8 < size:
        width *= 2
    buckets = max(8, size // (6 * (HOLD // 2)))
    keyed = docs.withColumns({"k1": F.coalesce("doc_id", F.lit(0)), "k2": F.xxhash64("doc_id", "text")})
    if width <= MAX_CELLS:
        sketch = spark.sparkContext.broadcast(collected_sketch(merged_sketch(docs, window, anchor, width), width))
        sent = keyed.select("k1", "k2", "text")
    else:
        sketch = None
        sent = keyed.join(repeated_anchors(keyed, window, anchor, width), ["k1", "k2"]).select("k1", "k2", "text", "anchors")
    places = sent.mapInArrow(_place_batches(window, anchor, width, buckets, sketch), _PLACES)
    repeated = places.groupBy("bucket").applyInArrow(_exact(buckets), _MARKS)
    marks = repeated.groupBy("bucket").applyInArrow(_by_document, "k1 long, k2 long, starts binary")
    return keyed.join(marks, ["k1", "k2"], "left").select("doc_id", "text", "starts").mapInArrow(_cut_batches(window), "doc_id long, n_words long, n_removed long, kept_text string")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Windows of 35 words over all documents."""
    cut = remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
