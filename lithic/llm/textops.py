"""Vectorised word and n-gram hashing over Arrow string batches.

The helpers run inside Spark tasks (``mapInArrow``). Texts stay UTF-8 bytes:
all word separators of the operators are ASCII, so cutting bytes and cutting
code points give the same words. Work goes through slices of about
``SLICE_BYTES`` so that memory does not depend on the batch or partition size;
only a single text longer than that makes a larger slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

_U = np.uint64
#: white space of the word pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = ~SPACE
#: bytes of the word pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing)
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x41:0x5B] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def _lane(seed: int, fold_case: bool) -> tuple[np.ndarray, int, int]:
    """Random byte table, odd base and its inverse modulo 2**64."""
    rng = np.random.Generator(np.random.PCG64(seed))
    table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    base = int(rng.integers(1 << 40, 1 << 62, dtype=np.uint64)) | 1
    if fold_case:
        table[0x41:0x5B] = table[0x61:0x7B]
    return table, base, pow(base, -1, 1 << 64)


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int, inverse: int) -> None:
        self._bases = (base, inverse)
        self._n = 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self._n:
            self._n = max(n, SLICE_BYTES + (SLICE_BYTES >> 2))
            self._tables = tuple(self._fill(b, self._n) for b in self._bases)
        up, down = self._tables
        return up[:n], down[:n]

    @staticmethod
    def _fill(base: int, n: int) -> np.ndarray:
        out = np.ones(n, dtype=np.uint64)
        done = 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * _U(pow(base, done, 1 << 64))
            done += step
        return out


class WordHasher:
    """64-bit hashes of byte ranges: one value per word, any number of words at once."""

    def __init__(self, seed: int, fold_case: bool = False) -> None:
        self._table, base, inverse = _lane(seed, fold_case)
        self._powers = _Powers(base, inverse)

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self._powers.get(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self._table[data] * up[:-1], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values with good avalanche."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


@dataclass
class Slice:
    """Rows first .. first+rows-1 of a batch: bytes and row offsets into them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word starts, word ends, and for each row the range of its words."""
        mask = inside[self.data]
        start, end = mask.copy(), mask.copy()
        start[1:] &= ~mask[:-1]
        end[:-1] &= ~mask[1:]
        lens = np.diff(self.offsets)
        first, last = self.offsets[:-1][lens > 0], self.offsets[1:][lens > 0] - 1
        start[first] |= mask[first]
        end[last] |= mask[last]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def text_and_rest(batch: pa.RecordBatch, inside: int | None) -> tuple[pa.Array, list[int]]:
    """A batch's text and the numbers of its other columns.

    The text is the last column, or field ``inside`` of the first one, a struct
    that is passed on as it is: then it crosses to Python only once.
    """
    if inside is None:
        *others, text = range(batch.num_columns)
        return batch.column(text), others
    return pc.struct_field(batch.column(0), [inside]), list(range(batch.num_columns))


def slices(column: pa.Array) -> Iterator[Slice]:
    """Cut a string column into slices; null counts as the empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, raw = column.buffers()
    n = len(column)
    if n == 0:
        return
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield Slice(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
    pa.default_memory_pool().release_unused()


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes; one value per start (len - n + 1)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    multiplier = _U(0x9E3779B97F4A7C15)
    # doubling: blocks of 1, 2, 4 ... words, put together by the bits of n
    block, width, out, covered = hashes, 1, None, 0
    while True:
        if n & width:
            if out is None:
                out, covered = block, width
            else:
                m = len(hashes) - covered - width + 1
                out = mix(out[:m] * multiplier + block[covered : covered + m])
                covered += width
        width *= 2
        if width > n:
            return out[:size] if out is not hashes else out[:size].copy()
        half = width // 2
        m = len(block) - half
        block = mix(block[:m] * multiplier + block[half : half + m]) if m > 0 else np.zeros(0, dtype=np.uint64)


def window_starts(ranges: np.ndarray, n: int, total: int) -> np.ndarray:
    """True for each word at which a window of n words of one row starts (length total - n + 1)."""
    ok = np.ones(max(total - n + 1, 0), dtype=bool)
    if n > 1:
        for k in range(1, n):
            cut = ranges[1:-1] - k
            ok[cut[(cut >= 0) & (cut < len(ok))]] = False
        # rows of fewer than n words: a boundary less than n-1 words back is marked above by the next one
    return ok


def row_of(ranges: np.ndarray) -> np.ndarray:
    """For each word the row it belongs to."""
    return np.repeat(np.arange(len(ranges) - 1), np.diff(ranges))


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Words inside a window of n words that starts at one of ``starts``."""
    step = np.zeros(total + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + n, total), -1)
    return np.cumsum(step[:-1]) > 0


