"""Vectorised word hashing: many texts at once in numpy, whole texts always."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

# Bytes of text hashed together; one longer text is a block of its own.
BLOCK_BYTES = 2_000_000
# Odd base of the polynomial over bytes (mod 2**64) and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.empty(n + 1, np.uint64)
    down = np.empty(n + 1, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = np.uint64(_BASE), np.uint64(_INVERSE)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_CACHE: list = [None, None]


def blocks(texts: Iterable[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, last + 1, encoded texts) of runs of about ``limit`` bytes."""
    first, size, held = 0, 0, []
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > limit:
            yield first, i, held
            first, size, held = i, 0, []
        held.append(data)
        size += len(data)
    if held:
        yield first, first + len(held), held


def word_table(
    texts: list[bytes], separators: np.ndarray = SPACES
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: hash, byte start, byte end (in the joined block) and text number.

    A-Z count as a-z; words are runs of bytes that are no separators.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    gap = separators[data]
    gap[np.cumsum(lengths) - 1] = True
    edge = np.diff(gap.astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(ends) > len(starts):
        ends = ends[ends > 0][: len(starts)]
    if _CACHE[0] is None or len(_CACHE[0]) <= len(data):
        _CACHE[0], _CACHE[1] = _powers(max(len(data), BLOCK_BYTES))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(
        (_LOWER[data].astype(np.uint64) + np.uint64(1)) * _CACHE[0][: len(data)], out=sums[1:]
    )
    hashes = mix((sums[ends] - sums[starts]) * _CACHE[1][starts])
    owner = np.searchsorted(np.cumsum(lengths), starts, "right")
    return hashes, starts, ends, owner


def grams(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` words from each position on, and whether they lie in one text."""
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, bool)
    last = len(hashes) - n + 1
    out = np.zeros(last, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[k : k + last]
    return mix(out), owner[:last] == owner[n - 1 :]
