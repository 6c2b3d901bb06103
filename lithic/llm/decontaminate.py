"""Benchmark decontamination with an FM-index for every shard of the documents.

A shard is a stretch of whole texts of one task, about ``SHARD_WORDS`` words.
Its text is the sequence of word numbers; numbers are those of the words in the
benchmark, every other word ends a run. Runs shorter than the shortest test
phrase cannot hold one and are left out before indexing, so no occurrence is
lost. The suffixes are sorted, the last column goes into a wavelet tree of bit
vectors with rank tables, and all test phrases are searched backwards at once:
each step maps the interval of every phrase by two ranks. Rows of the final
intervals walk back to the next sampled suffix position, which gives the place.
Overlapping occurrences merge into removal spans.

The phrases are the windows of ``window`` consecutive words of every item, or
the whole item where it is shorter. The benchmark is dealt out by hashes into
blocks of about ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` of text at most. One
block at a time comes to the driver, is broadcast and goes against all
documents; its finds are written to the shared folder and the broadcast is
destroyed before the next block is read. At the end the finds of all blocks come
together by text. A benchmark of one block needs no writing and no join.

Defined results: null texts have no words and are clean; items without words
are ignored; items that share an item_id count as one item; null item_ids are
left out of the item lists but their windows hit; rows with the same doc_id
each get their row; extra columns are ignored; an empty documents table gives
an empty result, an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lithic.llm import textops as T
from lithic.llm.common import drop_saved, modest_batches, new_path, packed, save, table

SHARD_WORDS = 1 << 20
#: suffix positions kept: one in so many
SAMPLE = 16
#: items and bytes of text of one block of test phrases, about
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
_U = np.uint64
_SEED = 7


# ---------------------------------------------------------------- FM-index


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only ties are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    # a rank is the place of the first suffix of its group
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = first
    tied = ~(fresh & np.append(fresh[1:], True))
    width = 1
    while tied.any():
        at = np.flatnonzero(tied)
        suffix = order[at]
        after = suffix + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        group = first[at]
        again = np.lexsort((second, group))
        suffix, second, group = suffix[again], second[again], group[again]
        order[at] = suffix
        split = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        head = np.maximum.accumulate(np.where(split, at, 0))
        first[at] = head
        rank[suffix] = head
        tied[at] = ~(split & np.append(split[1:], True))
        width *= 2
    return order


class WaveletTree:
    """Ranks of any symbol in a sequence, one level of bits for each binary digit."""

    def __init__(self, sequence: np.ndarray, digits: int) -> None:
        self._digits = digits
        self._levels = []
        order = sequence
        for level in range(digits - 1, -1, -1):
            bit = (order >> level) & 1
            ones = np.zeros(len(bit) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = int(len(bit) - ones[-1])
            self._levels.append((level, ones, zeros))
            order = np.concatenate([order[bit == 0], order[bit == 1]])
        # where each symbol's stretch begins after the last level
        self._begin: dict = {}

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, at = np.zeros_like(place), place
        for level, ones, zeros in self._levels:
            bit = (symbol >> level) & 1
            one_low, one_at = ones[low], ones[at]
            low = np.where(bit == 1, zeros + one_low, low - one_low)
            at = np.where(bit == 1, zeros + one_at, at - one_at)
        return at - low

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its rank there."""
        low, at = np.zeros_like(place), place
        symbol = np.zeros_like(place)
        for level, ones, zeros in self._levels:
            bit = ones[at + 1] - ones[at]
            symbol |= bit.astype(symbol.dtype) << level
            one_low, one_at = ones[low], ones[at]
            low = np.where(bit == 1, zeros + one_low, low - one_low)
            at = np.where(bit == 1, zeros + one_at, at - one_at)
        return symbol, at - low


class FMIndex:
    """Index of a text of symbols 1.. with 0 as its unique end."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text)
        self._tree = WaveletTree(text[order - 1], max(1, int(symbols).bit_length()))
        self._before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self._sampled = order % SAMPLE == 0
        self._sample_rank = np.concatenate([[0], np.cumsum(self._sampled)])
        self._samples = order[self._sampled]
        self._n = len(text)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [low, high) of phrases (rows of symbols, right-aligned)."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self._n, dtype=np.int64)
        for k in range(phrases.shape[1]):
            own = np.flatnonzero((lengths > k) & (low < high))
            if not len(own):
                break
            symbol = phrases[own, phrases.shape[1] - 1 - k]
            base = self._before[symbol]
            low[own] = base + self._tree.rank(symbol, low[own])
            high[own] = base + self._tree.rank(symbol, high[own])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of the suffix in each row."""
        found = np.empty(len(rows), dtype=np.int64)
        left, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(left):
            ready = self._sampled[at]
            found[left[ready]] = self._samples[self._sample_rank[at[ready]]] + steps
            left, at = left[~ready], at[~ready]
            if len(left):
                symbol, rank = self._tree.access(at)
                at = self._before[symbol] + rank
            steps += 1
        return found


# ---------------------------------------------------------------- phrases


class Phrases:
    """Test phrases of one block of items as numbers of the block's words."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int) -> None:
        piece_rows, hashes = [], []
        hasher = T.WordHasher(_SEED, fold_case=True)
        for piece in T.slices(pa.array([text for _, text in items], pa.string())):
            starts, ends, ranges = piece.words(T.ALNUM)
            words = hasher.ranges(piece.data, starts, ends)
            piece_rows += [words[a:b] for a, b in zip(ranges[:-1], ranges[1:], strict=True)]
        hashes = np.concatenate([np.zeros(0, dtype=np.uint64), *piece_rows])
        self.vocabulary = np.unique(hashes)
        windows: dict[bytes, list[int]] = {}
        lengths: dict[bytes, int] = {}
        for k, words in enumerate(piece_rows):
            number = np.searchsorted(self.vocabulary, words) + 1
            size = min(window, len(number))
            for a in range(len(number) - size + 1 if size else 0):
                key = number[a : a + size].tobytes()
                windows.setdefault(key, []).append(k)
                lengths[key] = size
        self.lengths = np.array([lengths[k] for k in windows], dtype=np.int64)
        self.symbols = np.zeros((len(windows), window), dtype=np.int64)
        for row, key in enumerate(windows):
            self.symbols[row, window - lengths[key] :] = np.frombuffer(key, dtype=np.int64)
        self.items = [sorted({items[k][0] for k in ks if items[k][0] is not None}) for ks in windows.values()]
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        # a table over the low bits skips most words outside the vocabulary
        self._hint = np.zeros(1 << 16, dtype=bool)
        self._hint[(self.vocabulary & _U(0xFFFF)).astype(np.int64)] = True

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Number of each word, 0 outside the vocabulary."""
        out = np.zeros(len(words), dtype=np.int64)
        hope = np.flatnonzero(self._hint[(words & _U(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, words[hope])
        same = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == words[hope]
        out[hope[same]] = at[same] + 1
        return out


class _Shard:
    """Runs of vocabulary words of some rows, and where they came from."""

    def __init__(self, phrases: Phrases) -> None:
        self._phrases = phrases
        self._symbols: list[np.ndarray] = []
        self._places: list[np.ndarray] = []

    def add(self, words: np.ndarray, ranges: np.ndarray, first: int) -> None:
        """Words of rows; ``first`` is the number of the first word in the shard."""
        if not self._phrases.shortest:
            return
        number = self._phrases.numbers(words)
        known = number > 0
        begin, end = known.copy(), known.copy()
        begin[1:] &= ~known[:-1]
        end[:-1] &= ~known[1:]
        edges = ranges[1:-1][(ranges[1:-1] > 0) & (ranges[1:-1] < len(words))]
        begin[edges] |= known[edges]
        end[edges - 1] |= known[edges - 1]
        a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
        long = b - a >= self._phrases.shortest
        a, size = a[long], (b - a)[long]
        if not len(a):
            return
        # each run is followed by a separator, the number after the last word's
        total = size + 1
        at = np.repeat(a - np.concatenate([[0], np.cumsum(total)[:-1]]), total) + np.arange(total.sum())
        symbols = number[np.minimum(at, len(number) - 1)]
        symbols[np.cumsum(total) - 1] = len(self._phrases.vocabulary) + 1
        self._symbols.append(symbols)
        self._places.append(at + first)

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """Phrase and first word of every occurrence."""
        none = np.zeros(0, dtype=np.int64)
        if not self._symbols:
            return none, none
        phrases = self._phrases
        index = FMIndex(np.concatenate(self._symbols), len(phrases.vocabulary) + 1)
        low, high = index.search(phrases.symbols, phrases.lengths)
        n = np.maximum(high - low, 0)
        phrase = np.repeat(np.arange(len(n)), n)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return phrase, np.concatenate(self._places)[index.locate(rows)]


_SPANS = "array<struct<start:int,end:int>>"
_FOUND = f"n_words long, spans {_SPANS}, items array<string>"
_OUT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]


def _find_batches(block, inside: int | None):
    """Marks each row's text; the other columns are passed on."""

    def marked(held: list, phrases: Phrases) -> pa.RecordBatch:
        counts = np.concatenate([np.diff(ranges) for _, ranges, _ in held])
        offsets = np.concatenate([[0], np.cumsum(counts)])
        hit = np.zeros(offsets[-1], dtype=bool)
        shard, first = _Shard(phrases), 0
        for words, ranges, _ in held:
            shard.add(words, ranges, first)
            first += len(words)
        phrase, place = shard.occurrences()
        for size in np.unique(phrases.lengths[phrase]).tolist():
            hit |= T.covered(place[phrases.lengths[phrase] == size], size, len(hit))
        doc = np.searchsorted(offsets, place, side="right") - 1
        seen = np.unique(doc * len(phrases.lengths) + phrase)
        items: dict[int, set[str]] = {}
        for d, p in zip((seen // len(phrases.lengths)).tolist(), (seen % len(phrases.lengths)).tolist(), strict=True):
            items.setdefault(d, set()).update(phrases.items[p])
        # spans of hit words by row
        row = np.repeat(np.arange(len(counts)), counts)
        begin, end = hit.copy(), hit.copy()
        begin[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
        end[:-1] &= ~hit[1:] | (row[1:] != row[:-1])
        a, b = np.flatnonzero(begin), np.flatnonzero(end)
        spans = pa.StructArray.from_arrays([pa.array((a - offsets[row[a]]).astype(np.int32)), pa.array((b + 1 - offsets[row[b]]).astype(np.int32))], names=["start", "end"])
        span_offsets = np.concatenate([[0], np.cumsum(np.bincount(row[a], minlength=len(counts)))]).astype(np.int32)
        names = held[0][2].schema.names
        own = pa.Table.from_batches([x for _, _, x in held]).combine_chunks()
        return pa.record_batch(
            [
                *(own.column(k).combine_chunks() for k in range(own.num_columns)),
                pa.array(counts),
                pa.ListArray.from_arrays(pa.array(span_offsets), spans),
                pa.array([sorted(items.get(d, ())) for d in range(len(counts))], pa.list_(pa.string())),
            ],
            names=[*names, "n_words", "spans", "items"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(*block.value)
        hasher = T.WordHasher(_SEED, fold_case=True)
        held, size = [], 0
        for batch in batches:
            text, others = T.text_and_rest(batch, inside)
            rest = batch.select(others)
            for piece in T.slices(text):
                starts, ends, ranges = piece.words(T.ALNUM)
                held.append((hasher.ranges(piece.data, starts, ends), ranges, rest.slice(piece.first, piece.rows)))
                size += len(starts)
                if size >= SHARD_WORDS:
                    yield marked(held, phrases)
                    held, size = [], 0
        if held:
            yield marked(held, phrases)

    return run


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each key without overlaps."""
    for batch in batches:
        merged = []
        for row in batch.column(1).to_pylist():
            own: list[list[int]] = []
            for start, end in sorted((s["start"], s["end"]) for s in row):
                if own and start <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], end)
                else:
                    own.append([start, end])
            merged.append([{"start": a, "end": b} for a, b in own])
        spans = pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        yield pa.record_batch([batch.column(0), spans, batch.column(2)], names=["key", "spans", "items"])


def _blocks(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The different items with their block, written by block, and the number of blocks."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    path = new_path(benchmark.sparkSession, "items")
    items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")).repartition("block").write.partitionBy("block").parquet(path)
    return benchmark.sparkSession.read.schema("item_id string, text string, block int").parquet(path), blocks


def send_block(spark: SparkSession, items: DataFrame, block: int, window: int):
    """One block of items on its way to all tasks."""
    rows = items.where(F.col("block") == block).select("item_id", "text").collect()
    return spark.sparkContext.broadcast(([(r.item_id, r.text) for r in rows], window))


def _text_key(text: Column) -> Column:
    """The same for equal texts only: finds depend on nothing but the text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10, carry: list[str] | None = None) -> DataFrame:
    """Every row of docs as a struct ``row`` with its hit words, items and removal spans.

    Spans are word numbers, end exclusive, and do not overlap or touch.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    items, blocks = _blocks(benchmark)
    rows, inside = packed(docs, carry or docs.columns)
    if blocks == 1:
        found = rows.mapInArrow(_find_batches(send_block(spark, items, 0, window), inside), StructType([rows.schema["row"], *StructType.fromDDL(_FOUND)]))
    else:
        text = F.col("text").cast("string")
        keyed = docs.select(_text_key(text).alias("key"), text.alias("text"))
        parts = []
        for block in range(blocks):
            sent = send_block(spark, items, block, window)
            hits = keyed.mapInArrow(_find_batches(sent, None), f"key string, {_FOUND}").where("size(spans) > 0")
            parts.append(save(hits.groupBy("key").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "finds"))
            sent.destroy()
        together = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        merged = save(together.mapInArrow(_merge_batches, f"key string, spans {_SPANS}, items array<string>"), "passages")
        drop_saved(*parts)
        n_words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
        whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry or docs.columns)).alias("row"), n_words.alias("n_words"), _text_key(text).alias("key"))
        found = whole.join(merged, "key", "left").drop("key")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    found = found.select("row", "n_words", none("spans", _SPANS).alias("spans"), F.array_sort(none("items", "array<string>")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select("row", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans for every row of docs(doc_id, text)."""
    found = find_passages(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window, ["doc_id"])
    return found.select("row.doc_id", *_OUT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs without a removal span, with all their columns."""
    return find_passages(docs, benchmark, window).where(~F.col("contaminated")).select("row.*")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Windows of ten words of all benchmark items against all documents."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")
