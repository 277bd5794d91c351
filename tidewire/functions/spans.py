"""Vectorised text primitives shared by the Arrow-batched operators.

A batch of texts is processed in slices of half a MB (`slices`), so the numpy temporaries stay
bounded whatever the batch size is; only a single text longer than a slice exceeds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

#: The six ASCII white-space bytes that end a word.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def lut(members: bytes) -> np.ndarray:
    """A boolean table over byte values."""
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


NON_SPACE = ~lut(SPACE)


@dataclass
class Slice:
    """Rows `first:last` of a batch: UTF-8 bytes of all texts and each text's byte offsets."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first

    def raw(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column (nulls count as empty) into slices of about `limit` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off_buf, data_buf = column.buffers()
    offsets = np.frombuffer(off_buf, dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        lo = offsets[at]
        yield Slice(at, to, data[lo : offsets[to]], offsets[at : to + 1] - lo)
        at = to


@dataclass
class Words:
    """Byte spans of all words of a slice; text i has words `off[i]:off[i+1]`."""

    starts: np.ndarray
    ends: np.ndarray
    off: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.off) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = NON_SPACE) -> Words:
    """Maximal runs of member bytes; a run never crosses from one text to the next."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(len(offsets), np.int64))
    inside = member[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(data)]] = False
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit integer over all others (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(29))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, a function of its bytes alone."""
    size = 1 << max(19, int(max(len(data), 1) - 1).bit_length())
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[np.minimum(starts, size - 1)])


def gram_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, at the position of its first word (last k-1 are cut)."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for j in range(k):
        factor = factor * 0xC2B2AE3D27D4EB4F % (1 << 64)
        out += word_hashes[j : j + n] * np.uint64(factor | 1)
    return mix(out)


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of `length` that begins at one of `starts`."""
    edge = np.zeros(n + length + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.asarray(starts) + length, -1)
    return np.cumsum(edge)[:n] > 0
