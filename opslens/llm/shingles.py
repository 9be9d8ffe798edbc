"""Word shingles of many texts at once, as 64-bit hashes computed on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BASE = 0x9E3779B97F4A7C15
PART_BYTES = 1 << 20


class Shingled(NamedTuple):
    first: int  # number of the part's first row in its batch
    hashes: np.ndarray
    bounds: np.ndarray  # hashes[bounds[i]:bounds[i + 1]] belong to row first + i


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    out = np.ones(n + 1, np.uint64)
    done = 1
    while done <= n:
        k = min(done, n + 1 - done)
        out[done : done + k] = out[:k] * np.uint64(pow(base, done, 1 << 64))
        done += k
    return out


class Powers:
    """Powers of a base and of its inverse, made longer when a text needs it."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) <= n:
            self.up, self.down = power_table(self.base, n), power_table(self.inverse, n)


def text_parts(column: pa.Array, part_bytes: int = PART_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds of each row) of consecutive rows of about ``part_bytes``; null is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + part_bytes, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds of each row's words) of the words between white space."""
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    solid = ~SPACE[data]
    before = np.concatenate(([True], ~solid[:-1])) | edge[:-1] if len(data) else np.zeros(0, bool)
    after = np.concatenate((~solid[1:], [True])) | edge[1:] if len(data) else np.zeros(0, bool)
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def shingled(column: pa.Array, size: int, powers: Powers) -> Iterator[Shingled]:
    """Hashes of the ``size``-word shingles of every row, repeats included.

    A-Z count as a-z.  A row of fewer words has one shingle, its whole sequence; a row without words none.
    """
    for first, data, bounds in text_parts(column):
        starts, ends, rows = words(data, bounds)
        powers.upto(len(data))
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * powers.up[: len(data)], out=prefix[1:])
        word = mix((prefix[ends] - prefix[starts]) * powers.down[starts])
        counts = np.diff(rows)
        made = np.where(counts >= size, counts - size + 1, counts > 0)
        out = np.concatenate(([0], np.cumsum(made)))
        owner = np.repeat(np.arange(len(counts)), made)
        at = rows[owner] + np.arange(out[-1]) - out[owner]
        length = np.minimum(counts[owner], size)
        hashes = length.astype(np.uint64)
        for k in range(size):
            has = k < length
            step = mix(hashes) * np.uint64(BASE)
            hashes = np.where(has, step + word[np.where(has, at + k, 0)], hashes) if len(word) else hashes
        yield Shingled(first, mix(hashes), out)
