"""Word shingles of a batch of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

# A polynomial modulo a power of two has equal values for words that are made for it; such words are long.
LONG_WORD = 24
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_TABLE = np.random.default_rng(20240229).integers(1, 2 ** 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all others (a finaliser of public hash functions)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every document's distinct shingles, by document and hash.

    A-Z count as a-z; words are what ASCII white space separates; a text with fewer words is one shingle of all its
    words, one without words has none.
    """
    raw = [t.encode().lower() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = ~_SPACES[data]
    edge = np.diff(np.concatenate([[False], inside]).astype(np.int8))
    starts = np.flatnonzero(edge == 1)
    ends = np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # polynomial hash of a word by differences of running sums
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * _powers(_STEP, len(data) - 1))])
    words = mixed((sums[ends] - sums[starts]) * _powers(_BACK, len(data))[starts] ^ (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        words[i] = np.frombuffer(digest, "<u8")[0]
    borders = np.cumsum([0] + [len(r) + 1 for r in raw])
    count = np.diff(np.searchsorted(starts, borders))
    doc = np.repeat(np.arange(len(texts)), count)
    first = np.cumsum(count) - count
    place = np.arange(len(words)) - first[doc]
    length = np.minimum(size, count[doc])  # of the shingle that starts here
    begins = place <= count[doc] - length
    short = count[doc] < size
    begins &= ~short | (place == 0)
    at = np.flatnonzero(begins)
    n = length[at]
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        has = n > k
        if has.all():  # always so but for texts shorter than a shingle
            h = mixed(h * _STEP + words[at + k] + np.uint64(k))
        else:
            h[has] = mixed(h[has] * _STEP + words[at[has] + k] + np.uint64(k))
    d = doc[at]
    for x, z in segments(d, len(texts)):
        h[x:z].sort()
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
    return d[new], h[new]


def segments(doc: np.ndarray, rows: int) -> zip:
    """(first, end) of every document's stretch of an array ordered by document."""
    count = np.bincount(doc, minlength=rows)
    ends = np.cumsum(count)
    return zip((ends - count).tolist(), ends.tolist(), strict=True)


def parity_bits(doc: np.ndarray, bit: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """Per document, packed, the parity of how many of its tokens fall on each bit."""
    count = np.zeros(rows * bits, np.uint8)  # wraps at 256, which keeps the parity
    np.add.at(count, doc * bits + bit.astype(np.int64), np.uint8(1))
    return np.packbits((count & 1).reshape(rows, bits), axis=1)
