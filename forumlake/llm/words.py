"""Hashes of the words of many texts at once, from one row of bytes."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np

STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
LOT = 1 << 18


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, "uint64")
    out[0] = 1
    return np.multiply.accumulate(out)


@functools.lru_cache(maxsize=1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(n, int(STEP)), _powers(n, pow(int(STEP), -1, 1 << 64))


def hashed_words(
    texts: Iterable[bytes], gaps: np.ndarray, values: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lots of texts as the hashes of all their words, and where each text begins among them.

    ``gaps`` tells which bytes part words, line ends among them, and ``values`` what a byte
    counts, which must not be zero. A word's hash is a difference of running sums of its
    bytes times powers of a number. Lots bound the memory; one text is in one lot.
    """
    lot, size = [], 0
    for text in texts:
        lot.append(text)
        size += len(text) + 1
        if size >= LOT:
            yield _words_of(lot, size, gaps, values)
            lot, size = [], 0
    if lot:
        yield _words_of(lot, size, gaps, values)


def _words_of(lot: list[bytes], size: int, gaps: np.ndarray, values: np.ndarray):
    data = np.frombuffer(b"\n".join([*lot, b""]), "uint8")
    up, down = _tables(max(2 * LOT, 1 << (size - 1).bit_length()))
    sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum(values[data] * up[:size])])
    gap = gaps[data]
    after = np.concatenate([[True], gap[:-1]])
    starts, ends = np.flatnonzero(~gap & after), np.flatnonzero(gap & ~after)
    words = (sums[ends] - sums[starts]) * down[starts]
    words ^= words >> np.uint64(31)
    text_ends = np.cumsum([len(t) + 1 for t in lot])
    return words * MIX, np.searchsorted(starts, np.concatenate([[0], text_ends]))


def in_order(words: list[np.ndarray], width: int) -> np.ndarray:
    """A hash of ``width`` word hashes in their order."""
    out = np.full(len(words[0]), width, "uint64")
    for word in words:
        out = (out + word) * STEP
        out ^= out >> np.uint64(29)
    out *= MIX
    return (out ^ out >> np.uint64(32)).view("int64")


def shingles_of(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, or of the whole if there are fewer."""
    width = min(width, len(words))
    if not width:
        return np.zeros(0, "int64")
    n = len(words) - width + 1
    return in_order([words[i : i + n] for i in range(width)], width)
