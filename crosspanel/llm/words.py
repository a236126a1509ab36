"""Words of a whole Arrow batch as flat numpy arrays: no Python loop over rows or words.

Hashes are 64-bit polynomial hashes of the lower-cased bytes (modulo 2**64, from prefix sums), mixed. They only
nominate: whatever they find is compared exactly afterwards or is a statistic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes worked on at once; a longer text is worked on alone.
BLOCK = 1 << 20

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, dtype=bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but letters and digits; bytes of longer UTF-8 characters belong to words.
_mark = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
SEPARATORS = {"space": _space, "mark": _mark}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = max(n + 1, BLOCK + 1)
            powers = []
            for b in (BASE, INVERSE):
                x = np.full(size + 1, b, dtype=np.uint64)
                x[0] = 1
                powers.append(np.cumprod(x, dtype=np.uint64))
            cls.up, cls.down = powers
        return cls.up, cls.down


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each, null as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def blocks(at: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of rows of about size bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j
        i = j


def spans(raw: np.ndarray, at: np.ndarray, separator: str = "space") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in raw, and for each row the number of its first word."""
    if not len(raw):
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(at), dtype=np.int64)
    gap = SEPARATORS[separator][raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[at] = True
    start, end = ~gap, ~gap
    start[1:] &= gap[:-1] | first[1:-1]
    end[:-1] &= gap[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, A-Z lower-cased."""
    up, down = _Powers.to(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((_lower[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row, and for each row the number of its first shingle.

    A row of fewer words has the one shingle of all its words; a row without words has none.
    """
    count = np.diff(first)
    have = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    at = np.concatenate([[0], np.cumsum(have)])
    if not len(words):
        return np.zeros(0, dtype=np.uint64), at
    inside = np.arange(at[-1]) - np.repeat(at[:-1], have)
    position = np.repeat(first[:-1], have) + inside
    room = np.repeat(np.minimum(count, k), have)
    padded = np.concatenate([words, np.zeros(k, dtype=np.uint64)])
    out = room.astype(np.uint64)
    for i in range(k):
        out = np.where(i < room, mix(out * np.uint64(BASE) + padded[position + i]), out)
    return out, at


def distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each row sorted and without repeats, and for each row the number of its first."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.searchsorted(row[new], np.arange(len(at)))


def simhash(hashes: np.ndarray, at: np.ndarray, lanes: int = 1) -> np.ndarray:
    """For each row lanes*64 majority bits of its shingle hashes (repeats count); zero for a row without shingles."""
    n = len(at) - 1
    out = np.zeros((n, lanes), dtype=np.uint64)
    size = np.diff(at)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    for lane in range(lanes):
        x = hashes if lane == 0 else mix(hashes + np.uint64((lane * BASE) & (2**64 - 1)))
        bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at[full], axis=0, dtype=np.int32)
        out[full, lane] = np.packbits(2 * ones > size[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out
