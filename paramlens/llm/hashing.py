"""Hashes of words and word runs over whole batches of text, as numpy array operations.

Texts are UTF-8 bytes laid end to end. A prefix sum of weighted bytes gives the hash of any
stretch as a difference, freed of its place by an inverse power. All arithmetic is modulo 2^64.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, room: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(room, base, dtype=np.uint64), np.full(room, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _room(n: int) -> int:
    return 1 << max(16, int(n).bit_length())


@dataclass
class Words:
    """The words of several texts: their hashes, and where the words of each text begin and end."""

    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def runs(self, k: int, salt: int = 0) -> np.ndarray:
        """The hash of the k words from each word on, whichever text they are in; n - k + 1 of them."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, dtype=np.uint64)
        up, down = _powers(_WORD_BASE, _room(n))
        words = mix(self.hashes ^ np.uint64(salt)) if salt else self.hashes
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words * up[:n], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * down[: n - k + 1] + np.uint64(k + salt))

    def whole(self, k: int) -> np.ndarray:
        """Which runs of k words lie within one text."""
        n = len(self.hashes)
        ok = np.zeros(n + 1, dtype=np.int32)
        size = np.maximum(self.last - self.first - (k - 1), 0)
        np.add.at(ok, self.first[size > 0], 1)
        np.add.at(ok, (self.first + size)[size > 0], -1)
        return np.cumsum(ok)[: max(0, n - k + 1)] > 0


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of texts that lie end to end: text i is ``data[offsets[i]:offsets[i + 1]]``."""
    n = len(data)
    if not n:
        none = np.zeros(len(offsets) - 1, dtype=np.int64)
        return Words(np.zeros(0, dtype=np.uint64), none, none)
    space = _SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    inside = ~space
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = _powers(_BASE, _room(n))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    at = np.searchsorted(starts, offsets)
    return Words(hashes, at[:-1], at[1:])


def pieces_hash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hash of each of the stretches that lie end to end."""
    up, down = _powers(_BASE, _room(len(data)))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) * down[offsets[:-1]] + (offsets[1:] - offsets[:-1]).astype(np.uint64))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and offsets; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A to Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def pieces(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of texts of about so many bytes each, and at least one text."""
    out, begin = [], 0
    while begin < len(offsets) - 1:
        end = int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1
        end = min(max(end, begin + 1), len(offsets) - 1)
        out.append((begin, end))
        begin = end
    return out
