"""Words and hashes of whole Arrow batches of texts, without a Python object for each word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_POWER = U(0x9E3779B97F4A7C15)
_SECOND = U(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and where each text begins in them (one more entry than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return raw, at - at[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """``begin`` and ``end`` are byte positions of each word in ``raw``; words first[d]:first[d + 1] are those of text d."""

    raw: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, seed: np.ndarray = _POWER) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        size = self.end - self.begin
        if not len(size):
            return np.empty(0, U)
        at = np.zeros(len(size), np.int64)
        np.cumsum(size[:-1], out=at[1:])
        keep = np.ones(int(size.sum()), np.int64)
        keep[0] = self.begin[0]
        keep[at[1:]] = self.begin[1:] - self.end[:-1] + 1
        letters = self.raw[np.cumsum(keep)].astype(U)
        # A letter's place in its word, as a running count that falls back to 0 where a word begins.
        step = np.ones(len(letters), np.int32)
        step[0] = 0
        step[at[1:]] = 1 - size[:-1].astype(np.int32)
        powers = np.cumprod(np.full(int(size.max()), seed | U(1), U))
        letters += U(1)
        letters *= powers[np.cumsum(step, dtype=np.int32)]
        return mix(np.add.reduceat(letters, at) ^ size.astype(U))


def split_words(column: pa.Array, lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text; ``lower`` turns A-Z to a-z first."""
    raw, at = text_bytes(column)
    if lower:
        raw = _LOWER[raw]
    n = len(raw)
    if not n:
        return Words(raw, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64))
    word = ~_SPACE[raw]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    edges = at[:-1][at[:-1] < n]
    begin[edges] = word[edges]
    end = word.copy()
    end[:-1] &= ~word[1:]
    last = at[1:][at[1:] > 0] - 1
    end[last] = word[last]
    begin = np.flatnonzero(begin)
    return Words(raw, begin, np.flatnonzero(end) + 1, np.searchsorted(begin, at))


def windows(h: np.ndarray, k: int, base: np.ndarray = _SECOND) -> np.ndarray:
    """A hash of each run of ``k`` values of ``h`` (by where it begins), by doubling; shorter than ``h`` by k - 1."""
    if len(h) < k:
        return np.empty(0, U)
    out, done, power, block, size = None, 0, int(base) | 1, h, 1
    # out covers the first ``done`` values of the run; block covers ``size`` values with multiplier power = base ** size.
    while True:
        if k & size:
            if out is None:
                out = block
            else:
                m = min(len(out), len(block) - done)
                out = out[:m] * U(power) + block[done : done + m]
            done += size
        if done == k:
            return mix(out[: len(h) - k + 1])
        block = block[: len(block) - size] * U(power) + block[size:]
        power = power * power % 2**64
        size *= 2


def sliding(x: np.ndarray, k: int, f: np.ufunc) -> np.ndarray:
    """``f`` (minimum or maximum) over each run of ``k`` values; shorter than ``x`` by k - 1."""
    size, block = 1, x
    while size * 2 <= k:
        block = f(block[:-size], block[size:])
        size *= 2
    return f(block[: len(x) - k + 1], block[k - size : k - size + len(x) - k + 1]) if size < k else block


def of_text(first: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
