"""Words of many texts at once as 64-bit hashes, by array operations on their bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C55
_CHUNK = 1 << 18
_BLOCK = 64

_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False

# A to Z in lower case, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit numbers over the whole range (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 1)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), _CHUNK)
            with np.errstate(over="ignore"):
                for name, base in (("up", self.base), ("down", self.inverse)):
                    steps = np.full(size, base, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_powers = _Powers(_BASE)


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the values in each [start, end); equal runs get equal hashes wherever they stand.

    Up to ``_BLOCK`` values are a polynomial modulo 2^64, whose low bits patterns of two values cancel as they
    grow longer. So longer runs are hashed in blocks from their start, and the blocks' hashes, mixed with their
    numbers, are added.
    """
    up, down = _powers.upto(len(values) + 1)
    sizes = ends - starts
    with np.errstate(over="ignore"):
        sums = np.empty(len(values) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(values * up[: len(values)], out=sums[1:])

        def blocks(first: np.ndarray, last: np.ndarray) -> np.ndarray:
            found = (sums[last] - sums[first]) * down[first]
            return mix(found + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

        if not len(sizes) or sizes.max() <= _BLOCK:
            return blocks(starts, ends)
        hashes = blocks(starts, np.minimum(ends, starts + _BLOCK))
        long = np.flatnonzero(sizes > _BLOCK)
        number = -(-sizes[long] // _BLOCK)
        owner = np.repeat(long, number)
        heads = np.cumsum(number) - number
        nth = np.arange(len(owner)) - np.repeat(heads, number)
        first = starts[owner] + nth * _BLOCK
        parts = blocks(first, np.minimum(first + _BLOCK, ends[owner]))
        hashes[long] = mix(np.add.reduceat(mix(parts ^ mix(nth.astype(np.uint64), 8)), heads), 9)
        return hashes


@dataclass
class Words:
    """Words of a batch of texts: hash, place in the bytes, and each text's range of words."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def split(raw: np.ndarray, offsets: np.ndarray, with_hashes: bool = True) -> Words:
    """Words of the texts ``raw[offsets[i]:offsets[i + 1]]``."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _IS_WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    bounds = np.searchsorted(starts, offsets)
    hashes = np.empty(len(starts) if with_hashes else 0, np.uint64)
    at = 0
    while at < len(hashes):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _CHUNK)))
        low, high = starts[at], ends[to - 1]
        hashes[at:to] = spans_hash(_BYTE[raw[low:high]], starts[at:to] - low, ends[at:to] - low)
        at = to
    return Words(hashes, starts, ends, bounds)


def runs(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ``length`` consecutive words of one text start, and the hash of each such run."""
    n = len(words.hashes)
    counts = np.diff(words.bounds)
    ok = np.ones(n, bool)
    if n:
        last = np.repeat(words.bounds[1:], counts)
        ok = np.arange(n) + length <= last
    starts = np.flatnonzero(ok)
    return starts, spans_hash(words.hashes, starts, starts + length)
