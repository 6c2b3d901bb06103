"""Token counts of a byte-level BPE vocabulary without making the tokens.

A text is cut at the vocabulary's special strings (one token each), the rest
into pre-tokens by the vocabulary's pattern. A pre-token of n bytes starts as a
linked list of n symbols; a heap holds its adjacent pairs by merge rank. The
lowest-rank pair is popped and merged again and again; the count is the number
of bytes less the number of merges. Stale heap entries are recognised by the
pair they were pushed for. Counts of short pre-tokens are remembered in a table
of bounded size.

The vocabulary is a file of known size that is read on the driver and broadcast.
A file with a normalizer, another pre-tokenizer, merges that are ignored or added
tokens that take in blanks is refused with an error.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows are
independent, so repeated rows and null ids need no rule; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import modest_batches, table

#: pre-tokens of the byte-level pattern; fixed values of the vocabulary format
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: pre-tokens whose counts are remembered, and their longest length
REMEMBER, REMEMBER_LENGTH = 1 << 20, 64
#: a vocabulary file may have this many bytes at most, as it is broadcast
MAX_VOCABULARY = 64 << 20


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of this format."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks of a tokenizer file: (left, right) -> (rank, merged), all as numbers."""

    def __init__(self, content: bytes) -> None:
        spec = json.loads(content)
        self._check(spec)
        symbol = _byte_symbols()
        number = {bytes([b]): b for b in range(256)}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        raw = lambda s: bytes(symbol[c] for c in s)
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            merged = number.setdefault(left + right, len(number))
            self.merges.setdefault((number[left], number[right]), (rank, merged))
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)


    @staticmethod
    def _check(spec: dict) -> None:
        """Only plain byte-level files are counted right; any other is refused."""
        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        wrong = [
            *(f"pre_tokenizer.{k}" for k, v in plain.items() if cut.get(k, v if k == "use_regex" else None) != v),
            *(k for k in ("normalizer", "post_processor", "truncation", "padding") if spec.get(k)),
            *(f"model.{k}" for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)),
            *(f"added_tokens.{k}" for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)),
        ]
        if model.get("type", "BPE") != "BPE" or wrong:
            raise ValueError(f"not a plain byte-level BPE vocabulary: {', '.join(wrong) or model.get('type')}")


def count_merged(raw: bytes, merges: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Symbols left of ``raw`` when no pair can be merged any more."""
    n = len(raw)
    symbol = list(raw)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        found = merges.get((symbol[i], symbol[i + 1]))
        if found:
            heap.append((found[0], i, found[1]))
    heapq.heapify(heap)
    left = n
    while heap:
        rank, i, merged = heapq.heappop(heap)
        j = after[i]
        # the left symbol is gone, has no neighbour, or the pair is no longer the one pushed
        if symbol[i] < 0 or j >= n or merges.get((symbol[i], symbol[j]), (-1,))[0] != rank:
            continue
        symbol[i], symbol[j] = merged, -1
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            found = merges.get((merged, symbol[k]))
            if found:
                heapq.heappush(heap, (found[0], i, found[1]))
        k = before[i]
        if k >= 0:
            found = merges.get((symbol[k], merged))
            if found:
                heapq.heappush(heap, (found[0], k, found[1]))
    return left


class Counter:
    """Token counts of texts, with a bounded memory of pre-token counts.

    A space between two characters that are no white space always starts a
    pre-token, so a text falls into independent chunks there; most chunks are
    words met before.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        merges, pieces = vocabulary.merges, regex.compile(PATTERN).findall
        self._special = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None
        self._any_special = vocabulary.special
        piece_count = _Memory(lambda piece: count_merged(piece.encode(), merges)).__getitem__
        self._slow = lambda text: sum(map(piece_count, pieces(text)))
        self._chunks = _Memory(lambda chunk: self._slow(" " + chunk) if chunk and not chunk[0].isspace() and not chunk[-1].isspace() else _UNSAFE)

    def plain(self, text: str) -> int:
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            n = sum(map(self._chunks.__getitem__, rest))
            if n >= 0:
                return n + self._slow(first)
        return self._slow(text)

    def count(self, text: str) -> int:
        if not any(s in text for s in self._any_special):
            return self.plain(text)
        parts = self._special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


class _Memory(dict):
    """Values of a function of strings, remembered up to a bound."""

    def __init__(self, make) -> None:
        self._make = make

    def __missing__(self, key: str) -> int:
        value = self._make(key)
        if len(key) <= REMEMBER_LENGTH:
            if len(self) >= REMEMBER:
                self.clear()
            self[key] = value
        return value


#: count of a chunk that is not independent of its neighbours; below minus any number of tokens
_UNSAFE = -(1 << 50)


@lru_cache(maxsize=2)
def _counter(content: bytes) -> Counter:
    """One counter for all tasks of a worker."""
    return Counter(Vocabulary(content))


def _count_batches(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary.value)
        for batch in batches:
            counts = np.fromiter((counter.count(t.as_py() or "") for t in batch.column(1)), dtype=np.int64, count=batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of docs(doc_id, text); ``vocabulary`` is a file."""
    modest_batches(docs.sparkSession)
    with open(vocabulary, "rb") as file:
        content = file.read(MAX_VOCABULARY + 1)
    if len(content) > MAX_VOCABULARY:
        raise ValueError(f"vocabulary of more than {MAX_VOCABULARY} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(content)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(_count_batches(shared), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of all documents under the byte-level vocabulary."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
