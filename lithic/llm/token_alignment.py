r"""Alignment of two tokenizers over a corpus, each distinct text once.

Texts are shuffled whole: equal texts meet, are counted, and every distinct text
is tokenised and aligned once by the byte-level vocabulary A (over a blank and
the text) and the piece vocabulary B (which adds that blank). Where tokens of A
and of B end at the same byte, the text is cut into groups; the tokens of a
group are linked. A pair of ids counts once for each document that holds it
linked, so a distinct text adds its multiplicity. The counts go back to the
distinct texts as bounded slices of a sorted table, all pairs of one A id in one
slice, and the measures go back to the documents by the digest of their text.

Within a text both tokenizers work chunk by chunk (``lithic.llm.chunks``), and so
does the alignment: a seam is a byte where both end.

Defined results: null and empty texts, and texts that either vocabulary does not
give back byte by byte, have no tokens: zeros and an empty string. Rows are
independent but for the counts, to which each adds one, so repeated rows and null
ids need no rule; extra columns are ignored; an empty table gives an empty
result. A piece vocabulary with a blank inside a piece is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.chunks import SEAM, ByteLevel, Memory, slices, vocabulary_bytes
from lithic.llm.common import drop_saved, modest_batches, save, table

BLANK = "▁"
#: pairs of ids that are broadcast at a time, of 17 bytes each
SLICE = 1 << 22
#: chunks remembered by a worker, of about 450 bytes each
REMEMBER = 1 << 19
#: the value of a chunk that one of the vocabularies does not give back
_BROKEN = ("", b"", b"")

ALIGNED = "digest string, n long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, links array<long>"
SCORED = "digest string, n_best long, count_sum long"


class Pieces:
    """A piece vocabulary: ids of many texts, and the bytes of each id."""

    def __init__(self, content: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        if any(BLANK in name.lstrip(BLANK) for name in names):
            raise ValueError("pieces of this vocabulary go across words")
        self.bytes = [bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace(BLANK, " ").encode() for i, name in enumerate(names)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Groups and links of texts under two vocabularies. The pair (a, b) has the code a * size of B + b."""

    def __init__(self, first: bytes, second: bytes) -> None:
        self.a, self.b = ByteLevel(first, special=False), Pieces(second)
        self.bits = (self.a.size * self.b.size).bit_length()
        self._memory = Memory(self._chunks, REMEMBER)

    def _chunks(self, chunks: list[str]) -> list[tuple[str, bytes, bytes]]:
        return list(map(self._align, chunks, self.a.chunk_ids(chunks), self.b.ids(chunks)))

    def _align(self, chunk: str, first: list[int], second: list[int]) -> tuple[str, bytes, bytes]:
        """Groups as text, the four numbers, and the codes of all links; _BROKEN if the bytes differ."""
        raw = (" " + chunk).encode()
        left, right = [self.a.bytes[i] for i in first], [self.b.bytes[i] for i in second]
        if b"".join(left) != raw or b"".join(right) != raw:
            return _BROKEN
        groups, codes, stride = [], [], self.b.size
        i = j = from_i = from_j = at_a = at_b = 0  # tokens taken, where the group begins, bytes behind what is taken
        while at_a < len(raw) or at_b < len(raw):
            if at_a <= at_b:
                at_a += len(left[i])
                i += 1
            else:
                at_b += len(right[j])
                j += 1
            if at_a == at_b:
                mine, other = first[from_i:i], second[from_j:j]
                groups.append(",".join(map(str, mine)) + "|" + ",".join(map(str, other)))
                codes += [x * stride + y for x in mine for y in other]
                from_i, from_j = i, j
        return ";".join(groups), np.array([len(first), len(second), len(groups), len(codes)], dtype=np.int64).tobytes(), np.array(codes, dtype=np.int64).tobytes()

    def texts(self, texts: list[str]) -> list[tuple[str, bytes, bytes]]:
        """(groups, numbers of each chunk, codes) of every text; three times empty without tokens."""
        cut = [t.split(" ") if t else [] for t in texts]
        known = self._memory.known(cut)
        return [self._put_together(t, [known[c] for c in chunks]) for t, chunks in zip(texts, cut, strict=True)]

    def _put_together(self, text: str, values: list) -> tuple[str, bytes, bytes]:
        if None in values:  # white space beside a blank: only seams cut
            chunks = SEAM.split(text)
            values = [self._align(c, self.a.ids(" " + c), self.b.ids([c])[0]) for c in chunks]
        if not values or _BROKEN in values:
            return _BROKEN
        groups, numbers, codes = zip(*values, strict=True)
        return ";".join(groups), b"".join(numbers), b"".join(codes)


@lru_cache(maxsize=2)
def _aligner(first: bytes, second: bytes) -> Aligner:
    """One aligner for all tasks of a worker."""
    return Aligner(first, second)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), type=pa.int32()), pa.array(values))


def _aligned(vocabularies):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*vocabularies.value)
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                found = aligner.texts(texts)
                numbers = np.array([np.frombuffer(n, dtype=np.int64).reshape(-1, 4).sum(axis=0) for _, n, _ in found], dtype=np.int64)
                codes = np.frombuffer(b"".join(c for _, _, c in found), dtype=np.int64)
                keys, links = np.unique(np.repeat(np.arange(len(texts)), numbers[:, 3]) << aligner.bits | codes, return_counts=True)
                sizes = np.bincount(keys >> aligner.bits, minlength=len(texts))
                rows = batch.slice(at, len(texts))
                at += len(texts)
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g, _, _ in found]
                arrays = [rows.column("digest"), rows.column("n"), *map(pa.array, numbers.T.copy()), pa.array(digests), _lists(keys & (1 << aligner.bits) - 1, sizes), _lists(links, sizes)]
                yield pa.record_batch(arrays, names=[f.split()[0] for f in ALIGNED.split(", ")])

    return run


def _scored(pairs):
    """Sums over the links of each text whose pairs are in a slice (sorted codes, counts, whether highest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = pairs.value
        for batch in batches:
            codes, times = batch.column("codes"), batch.column("links").flatten().to_numpy()
            flat, sizes = codes.flatten().to_numpy(), np.diff(codes.offsets.to_numpy())
            at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            here = times * (known[at] == flat)
            rows = np.repeat(np.arange(len(sizes)), sizes)
            sums = [np.zeros(len(sizes), dtype=np.int64) for _ in range(2)]
            np.add.at(sums[0], rows, here * best[at])
            np.add.at(sums[1], rows, here * counts[at])
            yield pa.record_batch([batch.column("digest"), *map(pa.array, sums)], names=["digest", "n_best", "count_sum"])

    return run


def aligned_texts(docs: DataFrame, first: str, second: str) -> DataFrame:
    """One saved row for each distinct text with tokens: digest, how many rows hold it, measures, its pairs and their links."""
    spark = docs.sparkSession
    modest_batches(spark)
    shared = spark.sparkContext.broadcast((vocabulary_bytes(first), vocabulary_bytes(second)))
    text = F.col("text").cast("string")
    distinct = docs.select(text.alias("text")).where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    rows = distinct.select(F.sha2("text", 256).alias("digest"), "n", "text")
    return save(rows.mapInArrow(_aligned(shared), ALIGNED).where("n_a > 0"), "aligned")


def pair_counts(aligned: DataFrame, stride: int) -> DataFrame:
    """code, n (documents that hold the pair) and best (none of its A id's pairs has more); A id = code div ``stride``."""
    counted = aligned.select("n", F.explode("codes").alias("code")).groupBy("code").agg(F.sum("n").alias("n"))
    counted = save(counted.withColumn("a", F.expr(f"code div {stride}")), "pairs")
    highest = counted.groupBy("a").agg(F.max("n").alias("highest"))
    return counted.join(highest, "a").select("a", "code", "n", (F.col("n") == F.col("highest")).alias("best"))


def align_tokens(docs: DataFrame, first: str, second: str, together: int = SLICE) -> DataFrame:
    """doc_id with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    aligned = aligned_texts(docs, first, second)
    pairs = save(pair_counts(aligned, sentencepiece.SentencePieceProcessor(model_file=second).get_piece_size()), "counts")
    n_slices = -(-pairs.count() // together) or 1
    scores = []
    for k in range(n_slices):
        part = pairs.where(F.pmod(F.xxhash64("a"), F.lit(n_slices)) == k).select("code", "n", "best").toArrow().sort_by("code")
        if part.num_rows:
            shared = spark.sparkContext.broadcast((part["code"].to_numpy(), part["n"].to_numpy(), part["best"].to_numpy()))
            scores.append(save(aligned.select("digest", "codes", "links").mapInArrow(_scored(shared), SCORED), "scores"))
            shared.destroy()
    drop_saved(pairs)
    measures = aligned.drop("codes", "links", "n")
    if scores:
        every = scores[0]
        for more in scores[1:]:
            every = every.unionByName(more)
        if len(scores) > 1:
            every = every.groupBy("digest").agg(*(F.sum(c).alias(c) for c in ("n_best", "count_sum")))
        measures = measures.join(every, "digest")
    else:
        measures = measures.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.col("text").cast("string"), 256).alias("digest"))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return rows.join(measures, "digest", "left").select("doc_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents under the byte-level and the piece vocabulary."""
    import public_tokenizers

    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
