"""Texts as chunks that tokenizers treat one by one, with a bounded memory of what they make of them.

A single blank between two characters that are no white space is a seam: the
byte-level pattern starts a pre-token there, and no piece of a word-wise piece
vocabulary goes across it. So the tokens of a text are those of its chunks, each
with the blank before it. Most chunks are words met before; those that are not
go through the tokenizer together, as one text, and are cut apart again by the
bytes of their tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from lithic.llm.token_counts import MAX_VOCABULARY, Vocabulary, _byte_symbols

#: chunks whose values are remembered, and the longest of them
REMEMBER, REMEMBER_LENGTH = 1 << 20, 64
#: characters of texts that are looked at together
TOGETHER = 1 << 19
SEAM = re.compile(r"(?<=\S) (?=\S)")
#: letters, blanks and other characters below U+0250 whose classes no version of Unicode disputes, and the byte-level pattern over them
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_SIMPLE = re.compile(rf"[\x09-\x0D\x20-\x7E{_LETTERS}]*").fullmatch
_PRETOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+").findall


def vocabulary_bytes(path: str) -> bytes:
    """A vocabulary file that is small enough to broadcast."""
    with open(path, "rb") as file:
        content = file.read(MAX_VOCABULARY + 1)
    if len(content) > MAX_VOCABULARY:
        raise ValueError(f"vocabulary of more than {MAX_VOCABULARY} bytes")
    return content


def slices(texts: pa.Array, together: int = TOGETHER) -> Iterator[list[str]]:
    """The texts of a column in order, in lists of bounded size; nulls are empty."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= together:
            yield held
            held, size = [], 0
    if held:
        yield held


def whole(chunk: str) -> bool:
    """Is ``chunk`` bounded by seams wherever it stands between two blanks?"""
    return bool(chunk) and not chunk[0].isspace() and not chunk[-1].isspace()


class Memory:
    """Values of chunks, made for many at once; ``make`` gets distinct whole chunks."""

    def __init__(self, make: Callable[[list[str]], list], remember: int = REMEMBER) -> None:
        self._make, self._remember = make, remember
        self._known: dict = {}
        self._long: list[str] = []

    def known(self, texts: list[list[str]]) -> dict:
        """chunk -> value for all chunks of ``texts``, None for those that are not whole."""
        for chunk in self._long:
            self._known.pop(chunk, None)
        if len(self._known) > self._remember:
            self._known.clear()
        new = set().union(*texts).difference(self._known)
        missing, parts = [], []
        for c in new:
            (missing if whole(c) else parts).append(c)
        self._known.update(zip(missing, self._make(missing), strict=True))
        self._known.update(dict.fromkeys(parts))
        self._long = [c for c in new if len(c) > REMEMBER_LENGTH]
        return self._known


class ByteLevel:
    """Ids of a plain byte-level vocabulary as its library gives them.

    ``special`` says whether special strings inside a text are special tokens (the library's default).
    """

    def __init__(self, content: bytes, special: bool = True) -> None:
        spec = json.loads(content)
        Vocabulary._check(spec)
        self.tokenizer = Tokenizer.from_buffer(content)
        self.tokenizer.encode_special_tokens = not special
        symbol = _byte_symbols()
        self._by_piece = Tokenizer.from_buffer(content)
        self._by_piece.encode_special_tokens = True
        self._by_piece.pre_tokenizer = pre_tokenizers.Split("\0", "removed")
        self._symbols = {b: c for c, b in symbol.items() if b}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = [s for s in added if special]
        entries = {i: bytes(symbol[c] for c in token) for token, i in spec["model"]["vocab"].items() if token not in added}
        self.size = max([*entries, *added.values()], default=-1) + 1
        self.bytes = [entries.get(i, b"") for i in range(self.size)]
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def chunk_ids(self, chunks: list[str], convert: Callable = np.ndarray.tolist, unit: int = 1) -> list:
        """Ids of each chunk with a blank before it: stretches of what ``convert`` makes of many ids, ``unit`` places an id."""
        simple = [_SIMPLE(c) is not None for c in chunks]
        made = {kind: iter(self._together([c for c, s in zip(chunks, simple, strict=True) if s == kind], kind, convert, unit)) for kind in (True, False)}
        return [next(made[kind]) for kind in simple]

    def _together(self, chunks: list[str], simple: bool, convert: Callable, unit: int) -> list:
        """Chunks as one text. Simple ones are cut into pre-tokens here, which spares the library its slowest step."""
        if not chunks:
            return []
        joined = " " + " ".join(chunks)
        if not any(s in joined for s in self.special):
            if simple:
                symbols = "\0".join(_PRETOKENS(joined)).encode().decode("latin-1").translate(self._symbols)
                found = self._by_piece.encode_batch_fast([symbols], add_special_tokens=False)[0].ids
            else:
                found = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids
            ids = np.array(found, dtype=np.uint32)
            ends, wanted = np.cumsum(self.lengths[ids]), np.cumsum([len(c.encode()) + 1 for c in chunks])
            cut = np.searchsorted(ends, wanted)
            if cut[-1] < len(ends) and np.array_equal(ends[cut], wanted):
                flat, places = convert(ids), [0, *((cut + 1) * unit).tolist()]
                return [flat[a:b] for a, b in zip(places, places[1:], strict=False)]
        return [convert(np.array(self.ids(" " + c), dtype=np.uint32)) for c in chunks]
