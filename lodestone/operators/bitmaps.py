"""Compressed sets of integers: per block of 65,536 numbers a list, runs or bits."""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 16
#: Numbers up to which a block is a list: beyond, bits take less room.
LIST = 4096

LISTED, RUNS, BITS = 0, 1, 2


def _packed(low: np.ndarray) -> tuple[int, np.ndarray]:
    """The smallest form of sorted different numbers of one block."""
    breaks = np.flatnonzero(np.diff(low) != 1)
    if 2 * (len(breaks) + 1) < min(len(low), LIST):
        first = low[np.concatenate(([0], breaks + 1))]
        last = low[np.concatenate((breaks, [len(low) - 1]))]
        return RUNS, np.stack((first, last)).astype(np.uint16)
    if len(low) <= LIST:
        return LISTED, low.astype(np.uint16)
    bits = np.zeros(BLOCK, dtype=bool)
    bits[low] = True
    return BITS, np.packbits(bits)


def _bits(kind: int, held: np.ndarray) -> np.ndarray:
    if kind == BITS:
        return np.unpackbits(held).view(bool)
    bits = np.zeros(BLOCK, dtype=bool)
    if kind == LISTED:
        bits[held] = True
        return bits
    edge = np.zeros(BLOCK + 1, dtype=np.int8)
    edge[held[0]] += 1
    edge[held[1].astype(np.int64) + 1] -= 1
    return np.cumsum(edge[:-1]).astype(bool)


def _numbers(kind: int, held: np.ndarray) -> np.ndarray:
    if kind == LISTED:
        return held.astype(np.int64)
    return np.flatnonzero(_bits(kind, held))


def _within(low: np.ndarray, kind: int, held: np.ndarray) -> np.ndarray:
    """Which of the numbers the block holds."""
    if kind == BITS:
        return (held[low >> 3] >> (7 - (low & 7))) & 1 == 1
    if kind == RUNS:
        at = np.searchsorted(held[0], low, side="right") - 1
        return (at >= 0) & (low <= held[1][np.maximum(at, 0)])
    at = np.minimum(np.searchsorted(held, low), len(held) - 1)
    return held[at] == low


class Bitmap:
    """A set of integers from 0 on."""

    __slots__ = ("blocks",)

    def __init__(self, blocks: dict[int, tuple[int, np.ndarray]]):
        self.blocks = blocks

    @classmethod
    def of(cls, numbers: np.ndarray) -> Bitmap:
        """The set of sorted different numbers."""
        numbers = np.asarray(numbers, dtype=np.int64)
        if not len(numbers):
            return cls({})
        high = numbers >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        return cls({int(part[0] >> 16): _packed(part & (BLOCK - 1)) for part in np.split(numbers, cuts)})

    def and_not(self, other: Bitmap) -> Bitmap:
        """What is in this set and not in the other."""
        out = {}
        for high, (kind, held) in self.blocks.items():
            there = other.blocks.get(high)
            if there is None:
                out[high] = (kind, held)
                continue
            low = _numbers(kind, held)
            left = low[~_within(low, *there)]
            if len(left):
                out[high] = _packed(left)
        return Bitmap(out)

    def numbers(self) -> np.ndarray:
        parts = [(high << 16) + _numbers(*block) for high, block in sorted(self.blocks.items())]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)

    def size(self) -> int:
        """Bytes that the blocks take."""
        return sum(held.nbytes for _, held in self.blocks.values())
