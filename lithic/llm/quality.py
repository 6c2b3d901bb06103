"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio.

Two multinomials over ``BUCKETS`` hashed word 1- and 2-grams are counted: one
on the trusted documents (label quality = 1), one on the whole corpus. A text's
score is the mean over its n-grams of log(p_trusted / p_corpus), so that long
and short texts compare. The threshold is fixed by the labelled documents that
pass the base rules: the cut between the two labels with the best balanced
accuracy, taken from counts of scores in steps of ``STEP`` and put in the middle
of the empty steps below it; ties go to the lowest cut. Every document is
counted, scored and thresholded; only ``BUCKETS`` numbers and the score counts
ever reach the driver. All labels count: up to ``FEW`` labelled ids are broadcast;
of more, a bit filter and a second one of the ids that pass it wrongly tell which
texts are trusted, so that only texts of ids with bits in both are moved to a join.

To see n-grams that a single word's spelling would hide, a word also counts by
its shape: its characters outside letters and digits, and whether it is all
upper case.

Defined results: null and empty texts have no words and fail the base rules;
a label row with a null id or quality is ignored; of several label rows with one
id the greatest quality counts; without trusted documents,
or without labelled documents of both kinds, the method passes everything;
rows with the same id each count; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lithic.llm import textops as T
from lithic.llm.common import modest_batches, packed, table
from lithic.sieve import may_match, settled

BUCKETS = 1 << 16
STEP = 0.01
#: labelled ids broadcast at most
FEW = 10_000
#: n-grams added to every bucket's count, as a share of the mean count
SMOOTH = 0.1
_U = np.uint64
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True
#: byte classes: 0 letters, digits and all beyond ASCII; 1 upper case; others are themselves
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x30:0x3A] = _SHAPE[0x61:0x7B] = _SHAPE[0x80:] = 0
_SHAPE[0x41:0x5B] = 1


def _per_row(values: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """Sums of values over consecutive ranges."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ranges[1:]] - total[ranges[:-1]]


def _bucket_numbers(piece: T.Slice, starts: np.ndarray, ends: np.ndarray, ranges: np.ndarray, words: np.ndarray, shaper: T.WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the rows, and the row of each."""
    row = T.row_of(ranges)
    shape = shaper.ranges(_collapsed(piece.data, starts), starts, ends)
    pairs = T.ngrams(words, 2)
    whole = T.window_starts(ranges, 2, len(words))
    grams = np.concatenate([words ^ _U(1), shape ^ _U(2), pairs[whole] ^ _U(3)])
    rows = np.concatenate([row, row, row[:-1][whole] if len(row) else row])
    return (T.mix(grams) >> _U(48)).astype(np.int64) % BUCKETS, rows


def _collapsed(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bytes by class; repeats of a letter class inside a word weigh nothing (byte 2)."""
    shape = _SHAPE[data]
    same = np.zeros(len(data), dtype=bool)
    same[1:] = (shape[1:] == shape[:-1]) & (shape[1:] < 2)
    same[starts] = False  # a row's first word follows the last byte of the row before
    return np.where(same, np.uint8(2), shape)


class _Shape(T.WordHasher):
    """Hash of the classes in a word by their number, whatever their places."""

    def __init__(self, seed: int) -> None:
        super().__init__(seed)
        self._table[2] = 0

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self._table[data], out=total[1:])
        return T.mix(total[ends] - total[starts])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, shaper = T.WordHasher(2), _Shape(22)
    counts = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        trusted = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
        for piece in T.slices(batch.column(0)):
            starts, ends, ranges = piece.words(T.WORD)
            bucket, row = _bucket_numbers(piece, starts, ends, ranges, hasher.ranges(piece.data, starts, ends), shaper)
            counts[0] += np.bincount(bucket, minlength=BUCKETS)
            own = trusted[piece.first : piece.first + piece.rows][row]
            counts[1] += np.bincount(bucket[own], minlength=BUCKETS)
    some = np.flatnonzero(counts[0])
    yield pa.record_batch([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], names=["bucket", "raw", "trusted"])


def log_ratios(docs: DataFrame, known: DataFrame | None = None) -> np.ndarray:
    """log(p_trusted / p_corpus) by bucket from docs(text, trusted); zeros without trusted documents.

    Trusted documents may come in a table ``known`` of their own besides docs."""
    count = lambda rows: rows.select("text", "trusted").mapInArrow(_count_batches, "bucket long, raw long, trusted long")
    partial = count(docs)
    if known is not None:
        partial = partial.unionByName(count(known).withColumn("raw", F.lit(0).cast("long")))
    counts = np.zeros((2, BUCKETS))
    for row in partial.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).collect():
        counts[0, row.bucket], counts[1, row.bucket] = row.raw, row.trusted
    if not counts[1].any():
        return np.zeros(BUCKETS)
    share = counts / counts.sum(axis=1, keepdims=True)
    share = (share + SMOOTH / BUCKETS) / (1 + SMOOTH)
    return np.log(share[1]) - np.log(share[0])


def _row_statistics(piece: T.Slice, starts: np.ndarray, ends: np.ndarray, ranges: np.ndarray, words: np.ndarray, hasher: T.WordHasher) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by row."""
    n_words = np.diff(ranges)
    inside = T.WORD[piece.data] & ((piece.data & 0xC0) != 0x80)
    word_chars = _per_row(inside, piece.offsets)
    n_symbols = _per_row(SYMBOLS[piece.data], piece.offsets)

    # lines: from a row's start or past a line feed, up to the next line feed or the row's end
    feeds = np.flatnonzero(piece.data == 0x0A)
    line_starts = np.concatenate([piece.offsets[:-1], feeds + 1])
    line_row = np.concatenate([np.arange(piece.rows), np.searchsorted(piece.offsets, feeds, side="right") - 1])
    order = np.lexsort((line_starts, line_row))
    line_starts, line_row = line_starts[order], line_row[order]
    last = np.append(line_row[1:] != line_row[:-1], True) if len(line_row) else np.zeros(0, dtype=bool)
    line_ends = np.where(last, piece.offsets[line_row + 1], np.append(line_starts[1:], 0) - 1)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line = hasher.ranges(piece.data, line_starts[has_word], line_ends[has_word]) + line_row[has_word].astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    _, first = np.unique(line, return_index=True)
    n_dup = np.bincount(line_row[has_word], minlength=piece.rows) - np.bincount(line_row[has_word][first], minlength=piece.rows)

    # 3-word windows that occur twice or more in their row
    row = T.row_of(ranges)
    whole = np.flatnonzero(T.window_starts(ranges, 3, len(words)))
    gram = T.ngrams(words, 3)[whole] + row[whole].astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    same = gram[1:] == gram[:-1]
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(gram) else np.zeros(0, dtype=bool)
    repeat = T.covered(whole[order[twice]], 3, len(words))
    return [n_words, word_chars, n_symbols, n_dup, _per_row(repeat, ranges)]


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def _score_batches(ratios, inside: int | None = None):
    """Statistics and score of each row's text; the other columns are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, shaper = T.WordHasher(2), _Shape(22)
        weight = ratios.value
        for batch in batches:
            text, others = T.text_and_rest(batch, inside)
            for piece in T.slices(text):
                starts, ends, ranges = piece.words(T.WORD)
                words = hasher.ranges(piece.data, starts, ends)
                stats = _row_statistics(piece, starts, ends, ranges, words, hasher)
                bucket, row = _bucket_numbers(piece, starts, ends, ranges, words, shaper)
                n = np.bincount(row, minlength=piece.rows)
                score = np.bincount(row, weights=weight[bucket], minlength=piece.rows) / np.maximum(n, 1)
                own = [batch.column(k).slice(piece.first, piece.rows) for k in others]
                yield pa.record_batch([*own, *(pa.array(x.astype(np.int64)) for x in stats), pa.array(score)], names=[*(batch.schema.names[k] for k in others), *(x.split()[0] for x in _OUT.split(", "))])

    return run


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def threshold(scored: DataFrame) -> float:
    """The cut with the best balanced accuracy from scored(score, quality) of labelled documents."""
    counts = scored.groupBy(F.floor(F.col("score") / STEP).alias("at"), "quality").count().collect()
    if {r.quality for r in counts} != {0, 1}:
        return float("-inf")
    places = sorted({r["at"] for r in counts})
    n = {(r["at"], r.quality): r["count"] for r in counts}
    good, bad = (sum(n.get((p, q), 0) for p in places) for q in (1, 0))
    best, at, good_below, bad_below = 0.0, float("-inf"), 0, 0
    for before, p in zip([places[0], *places], places, strict=False):
        gain = bad_below / bad - good_below / good
        if gain > best:
            best, at = gain, (min(before + 1, p) + p) / 2 * STEP
        good_below += n.get((p, 1), 0)
        bad_below += n.get((p, 0), 0)
    return at


def scored(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Every row of docs, its columns ``carry`` (all of them) as a struct ``row``, with the statistics, base_failed, score and kept."""
    spark = docs.sparkSession
    modest_batches(spark)
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    marks = labels.where("doc_id is not null and quality is not null").groupBy(doc_id.alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    few = marks.count() <= FEW
    texts = docs.select(doc_id.alias("doc_id"), text.alias("text"))
    good = marks.where("quality = 1").select("doc_id", F.lit(True).alias("trusted"))
    if few:
        ratios = log_ratios(texts.join(F.broadcast(good), "doc_id", "left").select("text", "trusted"))
        own = texts.join(F.broadcast(marks), "doc_id", "left_semi")
    else:
        # texts are counted where they lie; only those whose filter bits leave it open are moved to their ids
        told = settled(texts, ["doc_id"], good.select("doc_id"), "told")
        known = told.where("told is null").join(good, "doc_id").select("text", "trusted")
        ratios = log_ratios(told.select("text", F.col("told").alias("trusted")), known)
        own = may_match(texts, ["doc_id"], marks)
    ratios = spark.sparkContext.broadcast(ratios)
    labelled = own.select("doc_id", "text").mapInArrow(_score_batches(ratios), f"doc_id long, {_OUT}")
    labelled = labelled.where(~base_failed()).select("doc_id", "score").join(marks, "doc_id")
    cut = threshold(labelled.select("score", "quality"))
    rows, inside = packed(docs, carry or docs.columns)
    found = rows.mapInArrow(_score_batches(ratios, inside), StructType([rows.schema["row"], *StructType.fromDDL(_OUT)]))
    return found.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & (F.col("score") >= cut))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, score and kept for every row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(rows, labels, ["doc_id"]).select("row.doc_id", *(x.split()[0] for x in _OUT.split(", ")), "base_failed", "kept")


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    return scored(docs, labels).where("kept").select("row.*")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base rules and log-likelihood ratio over all documents."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
