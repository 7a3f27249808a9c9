"""Ids of texts by a word-level BPE vocabulary of the tokenizers library.

The vocabularies meant here drop white space and split before merging, so the ids of a text are those of its parts
one after another. Parts recur: the bytes of a batch are cut by masks, Arrow numbers the different parts, a worker
keeps the ids of those it has seen and asks the library for the others only, and the batch's ids are put together by
index.

Cuts are made where the tokenizer itself cuts whatever stands around: at ASCII white space, and in words within
Latin-1 (where lower-casing and normalising change one character at a time) after a run of letters. Texts that hold
an added token of the vocabulary, in whatever case, are left to the library as a whole.
"""

from __future__ import annotations

import hashlib
import os
import struct

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

# One thread per Spark task.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# So many parts of at most so many characters are kept by a worker.
KEEP, LONG_PART = 500_000, 64
_BYTE = np.arange(256, dtype=np.uint8)
_SPACE = np.isin(_BYTE, list(b" \t\n\x0b\x0c\r"))
_UPPER = (_BYTE >= ord("A")) & (_BYTE <= ord("Z"))
_LOWER = np.where(_UPPER, _BYTE + 32, _BYTE).astype(np.uint8)
_ASCII_LETTER = (_BYTE >= ord("a")) & (_BYTE <= ord("z"))
# Second bytes of the small letters of Latin-1 in UTF-8, after 0xC2 and 0xC3; fixed values.
_AFTER_C2 = np.isin(_BYTE, [0xAA, 0xB5, 0xBA])
_AFTER_C3 = ((_BYTE >= 0x9F) & (_BYTE <= 0xBF)) & (_BYTE != 0xB7)
_CAPITAL_AFTER_C3 = ((_BYTE >= 0x80) & (_BYTE <= 0x9E)) & (_BYTE != 0x97)
_ENCODERS: dict[bytes, WordEncoder] = {}


class _Kept(dict):
    """Values seen first stay, until so many others were asked for that they no longer fit the texts at hand."""

    missed = 0

    def add(self, new: dict) -> None:
        if len(self) + len(new) > KEEP:
            self.missed += len(new)
            if self.missed <= 4 * KEEP:
                return
            self.clear()
            self.missed = 0
        self.update((k, v) for k, v in new.items() if len(k) <= LONG_PART)


def _cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes in lower case, and where parts begin: at ends of white space and, in Latin-1 words, of letters."""
    low = _LOWER[data]
    after = np.concatenate([[0], data[:-1]])
    low = np.where((after == 0xC3) & _CAPITAL_AFTER_C3[data], low + 32, low).astype(np.uint8)
    second = ((after == 0xC3) & _AFTER_C3[low]) | ((after == 0xC2) & _AFTER_C2[low])
    letter = _ASCII_LETTER[low] | second
    letter[:-1] |= second[1:]
    space = _SPACE[data]
    border = np.ones(len(data), bool)
    border[1:] = space[1:] != space[:-1]
    run = np.cumsum(border) - 1
    wide = np.zeros(run[-1] + 1, bool)
    wide[run[data >= 0xC4]] = True  # words with characters beyond Latin-1 stay whole
    border[1:] |= letter[:-1] & ~letter[1:] & ~wide[run[1:]]
    return low, np.flatnonzero(border)


class WordEncoder:
    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts = _Kept()

    @staticmethod
    def of(vocabulary: str) -> WordEncoder:
        key = hashlib.sha256(vocabulary.encode()).digest()
        if key not in _ENCODERS:
            _ENCODERS[key] = WordEncoder(vocabulary)
        return _ENCODERS[key]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        whole = {}
        for i, text in enumerate(texts):
            low = text.lower()
            if any(a in low for a in self.added):
                whole[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        raw = [b"" if i in whole else t.encode() for i, t in enumerate(texts)]
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        if not len(data):
            return []
        low, start = _cut(data)
        offsets = np.append(start, len(low)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(low)).dictionary_encode()
        of_part = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())  # without a scalar per part
        size = np.fromiter(map(len, of_part), np.int64, len(of_part)) // 4
        first = np.cumsum(size) - size
        all_ids = np.frombuffer(b"".join(of_part), "<u4")
        part = coded.indices.to_numpy(zero_copy_only=False)
        n = size[part]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = all_ids[np.repeat(first[part] - ends[:-1], n) + np.arange(ends[-1])]
        # white space between texts has no ids, so it does not matter on which side it is counted
        borders = ends[np.searchsorted(start, np.cumsum([0, *(len(r) + 1 for r in raw)]))]
        return [whole.get(i, ids[a:z]) for i, (a, z) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True))]

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of different parts, as bytes."""
        found = list(map(self.parts.get, parts))
        new = [p for p, x in zip(parts, found, strict=True) if x is None]
        fresh = {}
        for at in range(0, len(new), 4096):
            some = new[at:at + 4096]
            for part, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                ids = e.ids
                fresh[part] = struct.pack(f"<{len(ids)}I", *ids)
        if fresh:
            found = [fresh[p] if x is None else x for p, x in zip(parts, found, strict=True)]
            self.parts.add(fresh)
        return found
