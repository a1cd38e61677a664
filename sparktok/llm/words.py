"""Words of many texts at once, as numpy arrays of hashes over Arrow's byte buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  Word hashes are
polynomials modulo 2**64 over a table of random byte values, taken as
differences of one prefix sum, then mixed; sequences of words are hashed the
same way.  Words of 256 bytes and more are hashed by xxh3 instead, which
leaves no long words on which the polynomial is weak.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SPACES = (0x20, *range(0x09, 0x0E))
LONG_WORD = 256


def _table(seed: int) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_64(bytes([b]), seed=seed).digest() for b in range(256)), dtype=">u8").astype(np.uint64)


def _is_space() -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(SPACES)] = True
    return out


def lowered(table: np.ndarray) -> np.ndarray:
    """The same table with A-Z read as a-z."""
    out = table.copy()
    out[65:91] = table[97:123]
    return out


IS_SPACE = _is_space()
#: Two independent hash functions: byte values and odd multipliers.
TABLES = (_table(11), _table(23))
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values: every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


#: Bytes hashed at a time: the prefix sums of a block stay small, and so do the powers.
BLOCK = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _both_powers(base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, as many as a block can need."""
    if int(base) not in _POWERS:
        size = BLOCK + LONG_WORD + 1
        _POWERS[int(base)] = powers(base, size), powers(np.uint64(pow(int(base), -1, 1 << 64)), size)
    return _POWERS[int(base)]


@dataclass
class Words:
    """Words of a list of texts; ``first[i]:first[i + 1]`` are those of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self, which: int = 0, lower: bool = False) -> np.ndarray:
        table = lowered(TABLES[which]) if lower else TABLES[which]
        up, down = _both_powers(MULTIPLIERS[which])
        out = np.empty(len(self.start), dtype=np.uint64)
        cuts = np.searchsorted(self.start, np.arange(0, len(self.data) + BLOCK, BLOCK))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            base = self.start[a]
            start = self.start[a:b] - base
            end = np.minimum(self.end[a:b] - base, start + LONG_WORD)
            sums = np.zeros(end[-1] + 1, dtype=np.uint64)
            np.multiply(table[self.data[base : base + end[-1]]], up[: end[-1]], out=sums[1:])
            np.cumsum(sums, out=sums)
            out[a:b] = mix((sums[end] - sums[start]) * down[start])
        for i in np.nonzero(self.end - self.start >= LONG_WORD)[0]:
            word = self.data[self.start[i] : self.end[i]].tobytes()
            out[i] = xxhash.xxh3_64(word.lower() if lower else word, seed=which + 101).intdigest()
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, n: int) -> np.ndarray:
        """Indices of words at which n words of one text begin."""
        if len(self.start) < n:
            return np.zeros(0, dtype=np.int64)
        return np.nonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])[0]


def texts_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array end to end, and the offsets of its texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    values = texts.buffers()[2]
    data = np.frombuffer(values, dtype=np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def split(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> Words:
    """Words of texts that lie end to end; ``space`` says which byte values part words."""
    gap = np.ones(len(data) + 2, dtype=bool)
    gap[1:-1] = space[data]
    inside = ~gap[1:-1]
    begins, ends = inside & gap[:-2], inside & gap[2:]
    full = offsets[:-1][np.diff(offsets) > 0]
    begins[full] = inside[full]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = inside[last]
    start, end = np.nonzero(begins)[0], np.nonzero(ends)[0] + 1
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def words_of(texts: pa.Array) -> Words:
    return split(*texts_buffer(texts))


def runs_hash(h: np.ndarray, at: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of the n values of h that begin at each place of ``at``."""
    out = np.zeros(len(at), dtype=np.uint64)
    base = MULTIPLIERS[1 - which]
    for k in range(n):
        out *= base
        out += h[at + k]
    return mix(out)
